"""Whitening against a dense eigensolver, exact integers and the defined cases."""

import numpy as np
import pytest

from cityweave.llm import whitening as w

AT = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>"


@pytest.mark.parametrize("seed", range(6))
def test_components_equal_a_dense_solver(seed):
    r = np.random.default_rng(seed)
    d = int(r.integers(1, 40))
    a = r.standard_normal((d, 2 * d)) * np.exp(r.uniform(-4, 4, (d, 1)))
    v = a @ a.T
    values, vectors = w.components(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=0, atol=1e-13 * np.trace(v) * d)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
    assert np.linalg.norm(v @ vectors - vectors * values) <= 1e-13 * d * np.linalg.norm(v)


@pytest.mark.parametrize("values", [[3.0] * 5, [2.0, 2.0, 1.0, 1.0, 1.0], [4.0, 0.0, 0.0], [0.0, 0.0], [5.0, 1.0, 1.0, 1.0 + 1e-9]])
def test_repeated_and_empty_eigenvalues(values):
    q, _ = np.linalg.qr(np.random.default_rng(3).standard_normal((len(values),) * 2))
    v = q * values @ q.T
    got, vectors = w.components((v + v.T) / 2)
    assert np.allclose(got, sorted(values, reverse=True), atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def brute(table, most=16):
    kept = [(i, [int(np.floor(64 * float(c))) + 1_000_000 for c in v]) for i, v in table]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[x - s / n for x, s in zip(row, total)] for row in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept:
        dev = sum((n * v - s) ** 2 for v, s in zip(x, total))
        y = np.array([v - s / n for v, s in zip(x, total)]) @ vectors / np.sqrt(values)
        for k in range(min(most, len(x))):
            out[i, k + 1] = (n, dev, y[k], values[k] / values.sum())
    return out


def test_query_equals_brute_force(spark):
    got = w.op13_whitening(spark, AT).collect()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{AT}/embeddings.parquet").collect()]
    want = brute(table)
    assert len(got) == len(want) == 16 * len(table)
    signs = {}
    for r in got:
        n, dev, y, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, dev)
        assert abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-9
        if abs(y) > 1e-3:
            signs.setdefault(r.component, np.sign(y * r.whitened))
        assert abs(r.whitened - y * signs.get(r.component, 1)) < 1e-6 * max(1, abs(y))


def test_odd_rows(spark):
    r = np.random.default_rng(1)
    table = [(i, [float(c) for c in r.standard_normal(3)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [1.0, float("inf"), 2.0]), (104, [1.0]), (105, [])]
    copies = [table[0], table[0], (None, table[1][1])]
    df = spark.createDataFrame([*table, *odd, *copies], SCHEMA).selectExpr("*", "1 as n", "'x' as Embedding_", "2 as `a.b`", "3 as VEC_ID")
    got = w.whitened(df).collect()
    assert len(got) == (40 + 3) * 3
    assert {r.n for r in got} == {40}
    assert {r[0] for r in got} == {*range(40), None}
    assert max(r.identity_error for r in got) < 1e-9


def test_empty_single_and_huge(spark):
    assert w.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    one = w.whitened(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, 0.0, None)] * 4
    huge = w.whitened(spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0]), (3, [-1e300, 2.0])], SCHEMA)).collect()
    assert {r.deviation for r in huge if r.vec_id != 2} == {None} and len(huge) == 6
