"""Histogram boosting against a serial booster, and against a matrix on planted data."""

import math

import numpy as np

from cityweave.operators import boosting as bo


def planted(n=600, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    gone = r.random(n) < 0.2
    y = np.where(gone, 2, (x[:, 0] * x[:, 1] > 0).astype(int))
    return [(i, [float(a), None if g else float(b), float(c)], int(k)) for i, ((a, b, c), g, k) in enumerate(zip(x, gone, y))]


def serial(rows, model, rounds, depth, rate, bins, least, ridge):
    """Plain loops over the same bins; scores by row."""
    b = [[0 if v is None else 1 + sum(v > e for e in model.edges[j]) for j, v in enumerate(x)] for _, x, _ in rows]
    scores = [list(model.start) for _ in rows]
    for _ in range(rounds):
        p = [[math.exp(s) / sum(map(math.exp, row)) for s in row] for row in scores]
        for k in range(len(model.start)):
            g = [q[k] - (y == k) for q, (_, _, y) in zip(p, rows)]
            h = [q[k] * (1 - q[k]) for q in p]
            nodes = {0: list(range(len(rows)))}
            for _ in range(depth):
                after = {}
                for node, own in nodes.items():
                    score = lambda s: sum(g[i] for i in s) ** 2 / (sum(h[i] for i in s) + ridge)  # noqa: B023, E731
                    best = (1e-9, None)
                    for f in range(len(b[0])):
                        for cut in range(bins + 1):
                            lo, hi = [i for i in own if b[i][f] <= cut], [i for i in own if b[i][f] > cut]
                            if len(lo) >= least and len(hi) >= least:
                                gain = round((score(lo) + score(hi) - score(own)) / 1e-9) * 1e-9
                                if gain > best[0]:
                                    best = (gain, (lo, hi))
                    lo, hi = best[1] or (own, [])
                    after[2 * node], after[2 * node + 1] = lo, hi
                nodes = after
            for own in nodes.values():
                value = -sum(g[i] for i in own) / (sum(h[i] for i in own) + ridge)
                for i in own:
                    scores[i][k] += rate * value
    return scores


def test_trees_equal_a_serial_booster_and_beat_a_matrix(spark):
    rows = planted()
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    model = bo.fit(df, 3, 3, rounds=3, depth=2, rate=0.3, most_bins=8, least=10)
    got = {r.id: r.p for r in bo.predicted(df, model).collect()}
    for (i, _, _), s in zip(rows, serial(rows, model, 3, 2, 0.3, 8, 10, 1.0)):
        want = [math.exp(v) / sum(map(math.exp, s)) for v in s]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[i], want))
    more = bo.fit(df, 3, 3, rounds=12, depth=3, rate=0.3, most_bins=16)
    fresh = planted(400, 9)
    out = bo.predicted(spark.createDataFrame(fresh, "id long, x array<double>, y int"), more).collect()
    right = sum(int(np.argmax(r.p)) == r.y for r in out) / len(out)
    common = max(sum(y == k for _, _, y in fresh) for k in range(3)) / len(fresh)
    assert right > common + 0.25
    assert all(int(np.argmax(r.p)) == 2 for r in out if r.x[1] is None)
