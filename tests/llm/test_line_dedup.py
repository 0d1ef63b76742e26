import duckdb
import pytest

from cityweave.llm import line_dedup

FOOT, HEAD, NEAR = "Contact us  ", "Home | News", "On nine sites"


def corpus():
    rows = []
    for i in range(12):
        text = f"{HEAD}\nown line {i}\n\n{FOOT}" + (f"\n{NEAR}" if i < 9 else "") + "\nseen once a site" * (i == 3) * 40
        rows.append((i, text, f"s{i}", i))
    return [*rows, (12, None, "s1", 0), (13, "", "s2", 0), (14, f" {FOOT}\n x ", None, 1), (0, rows[0][1], "s0", 0), (None, "a\nb", "s3", 1)]


def brute(rows, least=10):
    sites = {}
    for _, t, s, _ in rows:
        for x in (t or "").split("\n"):
            if x.strip(" ") and s is not None:
                sites.setdefault(x.strip(" "), set()).add(s)
    out = []
    for i, t, _, _ in rows:
        kept = [x for x in (t.split("\n") if t is not None else []) if len(sites.get(x.strip(" "), ())) < least]
        out.append((i, None if t is None else "\n".join(kept), len(t.split("\n")) - len(kept) if t is not None else 0))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [0, 1000])
def test_both_ways_against_brute_force(spark, bound):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string, n_chars long")
    out = line_dedup.remove_boilerplate(docs, report=True, broadcast_lines=bound)
    assert out.columns == ["doc_id", "text", "source", "n_chars", "n_lines", "n_removed"]
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=str) == brute(corpus())


def test_query_against_sql(spark, tmp_path):
    at = f"{tmp_path}/documents.parquet"
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, source string, n_chars long")
    docs.coalesce(1).write.parquet(at)
    got = line_dedup.op3_line_dedup(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/*.parquet'")
    want = con.execute(line_dedup.ORACLES["op3_line_dedup"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.remove_boilerplate(docs).collect() == []


def test_null_source_counts_for_none_and_clashing_columns(spark):
    rows = [(i, "common line\nown line %d" % i, f"s{i}" if i < 9 else None, 1, 2) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, TEXT int, `a.b` int")
    for most in (200_000, 0):
        kept = line_dedup.remove_boilerplate(docs, broadcast_lines=most, report=True)
        assert kept.columns == [*docs.columns, "n_lines", "n_removed"]
        assert {r[6] for r in kept.collect()} == {0}
        gone = line_dedup.remove_boilerplate(docs, min_sites=9, broadcast_lines=most, report=True)
        assert {r[6] for r in gone.collect()} == {1}
