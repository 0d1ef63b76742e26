import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cityweave.llm import bpe

PATH = bpe.default_tokenizer()
LIBRARY = Tokenizer.from_file(PATH)
CASES = [
    "", " ", "\n\n  x", "don't WE'LL it's", "a" * 5000, "the " * 3000, "naïve 日本語 🙂🙂 ½ ١٢٣", "<|endoftext|>a<|endoftext|>",
    "x<|endoftext|> <|endoftext", "tab\tsep\r\n\x1c\x1f\x85\xa0end", "é" * 200, "ab" * 40, "\x00\x01",
]


def ids(texts):
    return [bpe.ids_of(x).tolist() for x, _ in bpe.Codec(PATH).encoded(texts)]


@pytest.mark.parametrize("text", CASES)
def test_same_ids_as_library(text):
    assert ids([text])[0] == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=80), max_size=5))
def test_same_ids_on_any_text(texts):
    for text, got in zip(texts, ids(texts)):
        want = LIBRARY.encode(text, add_special_tokens=False).ids
        assert got == want
        assert bpe.decode(got, PATH) == LIBRARY.decode(want, skip_special_tokens=False)


def test_scalar_and_matrix_trees_agree():
    words = [w.encode() for w in ("hello", " world", "aaaaaaaaaa", "ththththe", "Ġ")]
    vocab = bpe.vocabulary(PATH)
    assert bpe.merge_rows(words, vocab) == [bpe.merge_long(w, vocab) for w in words]


def test_query_against_library(spark, tmp_path):
    rows = [(i, t, "extra") for i, t in enumerate([*CASES, None, CASES[4], CASES[4]])]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in bpe.op10_bpe(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        e = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(e)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, e)).encode()).hexdigest()
        back = LIBRARY.decode(e, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_empty_table_and_real_outputs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(empty, PATH).collect() == []
    one = spark.createDataFrame([(1, "hi there")], "doc_id long, text string")
    row = bpe.encode_documents(one, PATH).first()
    assert row.ids == LIBRARY.encode("hi there").ids and row.decoded == "hi there"
