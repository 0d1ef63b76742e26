import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from cityweave.llm import bpe, simhash

AT = "/root/testdata/sf0.01"


def test_stages_one_by_one(spark, tmp_path):
    docs = first = spark.read.parquet(f"{AT}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{AT}/labels.parquet").collect()}
    rows = [{r.doc_id: r for r in docs.collect()}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, AT)
        if k < 4:
            assert out.columns == first.columns and out.dtypes == first.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = docs.collect()
        rows.append({r.doc_id: r for r in got})
        assert len(got) == len(rows[-1])
    gone = rows[0].keys() - rows[1].keys()
    toxic = {i for i, t in labels.items() if t == 1}
    assert len(toxic - gone) <= 0.1 * len(toxic) and sum(labels.get(i) == 0 for i in gone) <= 2
    assert rows[2].keys() == rows[1].keys() and sum(rows[2][i].text != rows[1][i].text for i in rows[2]) > 0
    assert all(r.n_chars == len(r.text) for r in rows[2].values())
    copies = {}
    for i, r in sorted(rows[2].items()):
        if r.text.split():
            copies.setdefault(" ".join(r.text.lower().split()), []).append(i)
    assert all(i not in rows[3] for c in copies.values() for i in c[1:])
    assert rows[4].keys() == rows[3].keys() == rows[5].keys()
    library = Tokenizer.from_file(bpe.default_tokenizer())
    for i in list(rows[5])[::20]:
        assert rows[5][i].n_tokens == len(library.encode(rows[4][i].text, add_special_tokens=False).ids)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my ny xi omikron pi rho sigma tau ypsilon".split()
LONG = " ".join(WORDS[i * i % 20] + WORDS[i % 17] for i in range(20_000))


@pytest.fixture
def odd(spark, tmp_path):
    """Rows with nulls in every column, empty and long texts, repeated ids and rows, and columns of clashing names."""
    text = {c: " ".join(f"{c}{w}{i % 7}" for i, w in enumerate(WORDS * 2)) for c in "ABC"}
    rows = [(1, text["A"]), (2, text["A"]), (2, text["B"]), (3, text["A"]), (3, text["A"]), (5, text["C"]), (5, text["C"])]
    rows += [(None, text["A"]), (None, text["B"] + "!"), (6, None), (7, ""), (8, "  \n"), (9, None), (10, LONG), (11, LONG + " end")]
    rows = [(i, t, "en", None if n % 5 == 4 else f"s{n % 3}", None if t is None else len(t), f"x{n}", n, n, n, n, n) for n, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, _slot int, _block int, _toxicity int, score int, row int"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return spark.createDataFrame(rows, schema).coalesce(1), str(tmp_path)


def key(r):
    return str(tuple(r))


@pytest.fixture(autouse=True)
def case_sensitive(spark, request):
    if "odd" in request.fixturenames or "name" in request.fixturenames:
        spark.conf.set("spark.sql.caseSensitive", "true")  # else Spark itself can't write such a table
    yield
    spark.conf.set("spark.sql.caseSensitive", "false")


def test_stages_keep_odd_rows_and_names(spark, odd):
    docs, at = odd
    every = sorted(docs.collect(), key=key)
    for name in ("toxicity", "line_dedup", "mixing"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, at)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert sorted(out.collect(), key=key) == every, name
    out = dict(corpus_pipeline.STAGES)["bpe"](spark, docs, at)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in out.collect())
    library = Tokenizer.from_file(bpe.default_tokenizer())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, len(library.encode(r.text or "").ids)) for r in every)


def test_stages_resolve_names_without_case_sensitivity(spark, odd):
    docs, at = odd
    spark.conf.set("spark.sql.caseSensitive", "false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns and out.count() == (8 if name == "near_dedup" else 15), name


def test_near_copies_go_by_row_not_by_id(spark, odd):
    docs, at = odd
    out = corpus_pipeline.drop_near_copies(spark, docs, at)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    # of the rows of A the one of id 1; B stays under id 2; one of two rows of C; no wordless row goes; one long text stays
    got = sorted(r.TEXT for r in out.collect())
    assert got in [sorted(f"x{n}" for n in (0, 2, c, 9, 10, 11, 12, 13)) for c in (5, 6)]


def test_near_copies_by_fingerprint_and_by_sets(spark):
    """Texts of equal rhythm with tails of their own are near by operator 8's fingerprint alone, one with some new words by its
    shingle set alone; one text that is near two others joins them."""
    tail = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    beat = "red green blue " * 400
    words = (beat + tail("a", 30)).split()
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (beat + tail("a", 30), beat + tail("b", 30))]
    assert len(sets[0] & sets[1]) < 0.5 * len(sets[0] | sets[1])
    plain = tail("p", 200).split()
    edited = plain.copy()
    for i in (20, 90, 150):
        edited[i] = "new"
    prints = [simhash.fingerprint(t, 3) for t in (" ".join(words), beat + tail("b", 30), " ".join(plain), " ".join(edited))]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[2] ^ prints[3]).bit_count()
    # the shingles of the first, but not as often, so that its bits are others
    once = "red green blue " * 3 + tail("a", 30)
    assert (simhash.fingerprint(once, 3) ^ prints[0]).bit_count() > 3
    texts = [beat + tail("b", 30), " ".join(words), once, " ".join(plain), " ".join(edited), tail("q", 50)]
    docs = spark.createDataFrame([(i + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 4, 6]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_an_empty_table(spark, odd, name):
    docs, at = odd
    out = dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), at)
    assert out.collect() == [] and (name == "bpe" or out.columns == docs.columns)
