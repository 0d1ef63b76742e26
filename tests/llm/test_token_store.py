import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cityweave.llm import token_store as ts

PATH = ts.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
CASES = ["", " ", "Hello, World's 3 x", "é é ΣΑΣ ς\x1cA\x1f b\x85c\xa0d", "<|endoftext|>x <|startoftext|>", "<|ENDOFTEXT|> Éß÷ ÀÖ été, h\u0331 H\u0331 (a) it's. x.. K's", "a" * 3000, "日本 語🙂 ½", None]


def table_of(ids):
    symbols, counts = np.unique(ids, return_counts=True)
    return ts.Table(symbols, counts)


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, ts.CHECKPOINT_TOKENS + 777, ts.BLOCK_TOKENS])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 49407).astype(np.uint32)
    table = table_of(ids)
    raw = ts.encode_block(ids, table, b"idx")
    assert (ts.decode_block(raw, table) == ids).all() and ts.read_block(raw)[4] == b"idx"
    marks = ts.read_block(raw)[2]
    if len(marks) > 1:
        assert (ts.decode_block(raw, table, 1) == ids[ts.CHECKPOINT_TOKENS :]).all()
    with pytest.raises(ValueError):
        ts.decode_block(raw[:30] + bytes([raw[30] ^ 1]) + raw[31:], table)


def test_table_sums_and_size():
    t = ts.Table(np.arange(3000), np.r_[np.full(2999, 1), 10**9])
    assert int(t.freq.sum()) == 1 << t.bits and t.freq.min() == 1
    ids = np.repeat(np.arange(4, dtype=np.uint32), 20000)
    assert len(ts.encode_block(ids, table_of(ids))) < len(ids) / 4 * 1.6  # two bits each and lane states


def test_crc_join():
    a, b = b"abc" * 11, b"xyz!" * 7
    assert ts.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(st.characters(codec="utf-8"), max_size=60), st.text("abzAZ .,'!éÉßñ÷\u0301<|", max_size=40)), max_size=4))
def test_words_give_the_ids_of_whole_texts(texts):
    coder = ts.WordEncoder(PATH)
    got = coder.encoded(pa.array(texts, pa.string())).to_pylist()
    assert [np.frombuffer(x, coder.kind).tolist() for x in got] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_units_are_forgotten_and_asked_again(monkeypatch):
    monkeypatch.setattr(ts, "CACHE_UNITS", 4)
    coder = ts.WordEncoder(PATH)
    for texts in (["one two, three!!! it's", None, ""], ["two three four\" five-six Ñandú"], ["one one, one"]):
        got = coder.encoded(pa.array(texts, pa.string()), b"\1\0").to_pylist()
        want = [[*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert [np.frombuffer(x, coder.kind).tolist() for x in got] == want
    assert len(coder.units) <= 4


def test_portions():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["abc", None, "d" * 50, "e"])], ["k", "t"])
    assert [b.column(0).to_pylist() for b in ts.portions(batch, 4)] == [[1, 2], [3], [4]]


@pytest.mark.parametrize("block", [500, None])
def test_query_against_library(spark, tmp_path, block):
    rows = [(i * 3 % 40, t, 1) for i, t in enumerate(CASES * 3)] + [(None, "null id", 1)]
    rows = [(i if i is None else n, t, x) for n, (i, t, x) in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, N int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    if block:  # documents that span blocks
        made = ts.write_and_read(spark.read.parquet(f"{tmp_path}/documents.parquet"), PATH, block_tokens=block)
    else:
        made = ts.op1_token_store(spark, str(tmp_path))
    got = sorted(made.collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)


def test_equal_ids_and_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([(5, "b"), (5, "a"), (5, "a")], "doc_id long, text string")
    out = ts.write_and_read(docs, PATH).collect()
    assert sorted(r.start for r in out) == [0, 2, 4]
    assert ts.write_and_read(docs.limit(0), PATH).collect() == []
