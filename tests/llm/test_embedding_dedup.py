import math

import numpy as np
import pytest

from cityweave.llm import embedding_dedup as ed


def brute(rows, cosine=0.95):
    good = [
        (i, np.array(v, dtype="<f4").astype(float)) for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    x = np.zeros((len(good), max((len(v) for _, v in good), default=0)))
    for r, (_, v) in enumerate(good):
        x[r, : len(v)] = v
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= cosine
    ids = [i for i, _ in good]
    comp = list(range(len(good)))
    for _ in comp:
        new = [min((comp[j] for j in np.flatnonzero(near[i])), key=lambda c: ids[c]) for i in range(len(good))]
        if new == comp:
            break
        comp = new
    out = [(ids[i], int(near[i].sum()) - 1, ids[comp[i]], ids[comp[i]] == ids[i]) for i in range(len(good))]
    used = {id(v) for _, v in good}
    del used
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            out.append((i, 0, i, i is not None))
    return sorted(out, key=str)


def rows(n=400, dims=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dims))
    v = np.concatenate([base, base + 0.15 * rng.normal(size=base.shape), rng.normal(size=(n // 4, dims)), base[:1] + 0.1 * rng.normal(size=(n // 4, dims))])
    return [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]


@pytest.mark.parametrize("block", [16, 2048])
def test_against_brute_force(spark, block):
    data = rows()
    data += [(900 + i, data[5][1]) for i in range(30)] + [(950, [2 * x for x in data[5][1]])]
    data += [(960, None), (961, [0.0] * 16), (962, [float("nan")] * 16), (963, [None] * 16), (None, data[1][1]), (964, data[7][1][:15] + [0.0]), (965, data[7][1][:15])]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<float>, ID int")
    got = sorted(map(tuple, ed.near_duplicates(df, recall=1.0, block_rows=block).collect()), key=str)
    want = brute(data)
    assert [g[0] for g in got] == [w[0] for w in want]
    links, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and links >= 0.98 * true
    assert sum(g != w for g, w in zip(got, want)) <= 0.05 * len(want)


def test_query_recall_on_the_table(spark):
    at = "/root/testdata/sf0.01"
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    got = {r.vec_id: tuple(r) for r in ed.op7_embedding_dedup(spark, at).collect()}
    want = {w[0]: w for w in brute(table)}
    assert got.keys() == want.keys()
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(g[1] for g in got.values()) >= 0.9 * sum(w[1] for w in want.values())


def test_multi_sequence_is_in_order_of_distance():
    x = np.random.default_rng(3).normal(size=(200, 8))
    index = ed.Index(x, 8)
    cells = index.cells(x[:20], 64)
    first, second = index.distances(x[:20])
    for r in range(20):
        d = [first[r, c // 8] + second[r, c % 8] for c in cells[r]]
        assert sorted(cells[r]) == list(range(64)) and all(a <= b + 1e-12 for a, b in zip(d, d[1:]))
        assert index.rank(x[r : r + 1], cells[r, 5:6])[0] in (4, 5, 6)


def test_empty_table(spark):
    assert ed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def own_of(spark, vectors):
    return spark.createDataFrame([(bytearray(v.astype("<f4").tobytes()),) for v in vectors], "v binary")


def test_visits_are_not_set_by_one_tight_group(spark):
    rng = np.random.default_rng(8)
    tight = rng.normal(size=(1, 16)) + 0.001 * rng.normal(size=(600, 16))
    a = rng.normal(size=(200, 16))
    away = rng.normal(size=a.shape)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away -= (away * a).sum(axis=1)[:, None] * a
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    b = 0.951 * a + (1 - 0.951**2) ** 0.5 * away
    rows = [v.astype("<f4").tobytes() for v in np.concatenate([tight, a, b])]
    x = ed.unit(rows, 16)
    index = ed.Index(ed.unit([v.astype("<f4").tobytes() for v in rng.normal(size=(500, 16))], 16), 16)
    trial = np.concatenate([x[:100], x[600:800]])
    visits = ed.visits_for(index, own_of(spark, x), trial, 16, 0.95, 0.995)
    p, q = x[600:800], x[800:]
    rank = np.minimum(index.rank(p, index.cells(q, 1)[:, 0]), index.rank(q, index.cells(p, 1)[:, 0]))
    assert (rank < visits).mean() >= 0.99


def test_visits_are_measured_without_partners(spark):
    rng = np.random.default_rng(9)
    x = ed.unit([v.astype("<f4").tobytes() for v in rng.normal(size=(400, 16))], 16)
    index = ed.Index(x[200:], 16)
    assert ed.visits_for(index, own_of(spark, x), x[:200], 16, 0.95, 0.995) > 4
