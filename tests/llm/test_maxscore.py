import math

import duckdb
import numpy as np
import pytest

from cityweave.llm import maxscore


def brute(rows, k=5, step=50):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    out = []
    for q, x in good.items():
        if q % step == 0:
            s = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good.items() if i != q)[:k]
            out += [(q, n + 1, i, -t) for n, (t, i) in enumerate(s)]
    return sorted(out)


def some_rows(n, dims, seed=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    v[n // 2 :] = v[: n - n // 2] + 0.01 * rng.normal(size=(n - n // 2, dims))
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v / np.linalg.norm(v, axis=1)[:, None])]


@pytest.mark.parametrize("shard,block", [(40, 2), (16384, 2048)])
def test_against_brute_force(spark, shard, block):
    rows = some_rows(260, 16)
    rows[3] = (3, rows[50][1])
    rows[4] = (4, rows[50][1])
    rows[7], rows[100] = (7, None), (100, [float("nan")] * 16)
    rows[9] = (9, [None, 1.0])
    rows += [(None, rows[0][1]), rows[5], rows[0], (500, [0.0] * 16), (501, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = maxscore.integers(df)
    got = sorted(map(tuple, maxscore.top_k(v, v.where("id % 50 = 0"), shard_rows=shard, block_queries=block).collect()))
    assert got == brute(rows)


def test_query_against_sql(spark, tmp_path):
    df = spark.createDataFrame(some_rows(200, 64, 1), "vec_id long, embedding array<float>")
    df.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(maxscore.ORACLES["op9_maxscore"]).fetchall())
    assert sorted(map(tuple, maxscore.op9_maxscore(spark, str(tmp_path)).collect())) == want


def test_fewer_candidates_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    v = maxscore.integers(df)
    assert [tuple(r) for r in maxscore.top_k(v, v.where("id = 0")).collect()] == [(0, 1, 1, 131072)]
    assert maxscore.top_k(v.limit(0), v.limit(0)).collect() == []


def test_heads_skip_postings_and_keep_the_result():
    rows = some_rows(4000, 32, 3)
    ids, docs = np.arange(4000), np.array([[math.floor(256 * x) for x in v] for _, v in rows])
    p = maxscore.Postings(ids, docs)
    for i in range(0, 4000, 100):
        at, score = p.best(i, docs[i], 5, -np.inf)
        every = docs @ docs[i]
        every[i] = -(10**15)
        want = np.lexsort((ids, -every))[:5]
        assert (at == want).all() and (score == every[want]).all()
    assert p.touched < 0.55 * 40 * docs.size and p.probed < 0.1 * 40 * docs.size


def test_pieces_below_the_threshold_are_not_entered():
    docs = np.array([[3, 1], [2, 2], [1, -5]])
    p = maxscore.Postings(np.arange(3), docs)
    assert len(p.best(9, np.array([1, 1]), 1, 6.0)[0]) == 0 and p.touched == 0
    at, score = p.best(9, np.array([1, 1]), 2, 4.0)
    assert (at.tolist(), score.tolist()) == ([0, 1], [4, 4])
    assert [x.tolist() for x in p.best(9, np.array([0, 0]), 2, -np.inf)] == [[0, 1], [0, 0]]


def test_only_shards_in_reach_are_visited(spark):
    rng = np.random.default_rng(5)
    base = np.repeat(np.eye(8), 50, axis=0) * 4 + 0.1 * rng.random((400, 8))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)] + [(1000, None)]
    v = maxscore.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = sorted(map(tuple, maxscore.top_k(v, v.where("id % 50 = 0"), shard_rows=50, block_queries=3).collect()))
    assert got == brute(rows)
