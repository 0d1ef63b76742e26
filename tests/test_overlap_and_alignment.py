"""Stretches along lines against dense samples, decks, enrichment, and fits against planted displacements."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cityweave.operators import alignment as al
from cityweave.operators import overlap as op

LINE = "id long, seq int, x1 double, y1 double, x2 double, y2 double"
EDGE = "other long, x1 double, y1 double, x2 double, y2 double"


def gap(p, a, b):
    d = b - a
    t = np.clip(((p - a) @ d) / max(d @ d, 1e-30), 0, 1)
    return np.linalg.norm(p - a - t[..., None] * d, axis=-1)


def test_stretches_equal_dense_samples(spark):
    r = random.Random(2)
    xy = lambda: [r.uniform(0, 4) for _ in range(4)]
    lines = [(i, s, *xy()) for i in range(6) for s in range(2)] + [(9, 0, 0.0, 1.0, 4.0, 1.0)]
    others = [(i, *xy()) for i in range(12)] + [(20, 1.0, 1.2, 3.0, 1.2), (21, 2.0, 0.0, 2.0, 0.9), (22, 1.0, 1.0, 1.0, 1.0)]
    have = op.with_positions(spark.createDataFrame(lines, LINE))
    near = op.joined(op.near_stretches(have, spark.createDataFrame(others, EDGE), 0.5, 1.0), ["id", "other"])
    got = {}
    for x in near.collect():
        got[x.id, x.other] = got.get((x.id, x.other), 0.0) + x.hi - x.lo
    for i in {x[0] for x in lines}:
        for o, *b in others:
            want = 0.0
            for _, _, *a in (x for x in lines if x[0] == i):
                a0, a1 = np.array(a[:2]), np.array(a[2:])
                t = (np.arange(4000) + 0.5) / 4000
                want += (gap(a0 + t[:, None] * (a1 - a0), np.array(b[:2]), np.array(b[2:])) <= 0.5).mean() * np.linalg.norm(a1 - a0)
            assert math.isclose(got.get((i, o), 0.0), want, abs_tol=0.01), (i, o)
    assert all(0 < x.share <= 1 + 1e-9 for x in op.shares(have, near).collect())


def test_deck_over_pieces(spark):
    square = lambda x, y, h: [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)]
    pieces = [(1, square(20.0, 0.0, 15.0), 12.0), (2, square(60.0, 0.0, 12.0), 14.0), (3, square(95.0, 40.0, 5.0), 90.0), (4, square(90.0, 0.0, 1.0), 50.0)]
    rings = spark.createDataFrame(pieces, "other long, ring array<struct<x: double, y: double>>, top double")
    road = op.with_positions(spark.createDataFrame([(7, 0, 0.0, 0.0, 50.0, 0.0), (7, 1, 50.0, 0.0, 100.0, 0.0), (8, 0, 0.0, 300.0, 10.0, 300.0)], LINE))
    ground = spark.range(-20, 40).select(F.explode(F.sequence(F.lit(-20), F.lit(40))).alias("row"), F.col("id").alias("col"), F.lit(2.0).alias("z"))
    got = op.deck_heights(road, rings, ground, 5.0, 2.0, 10.0).collect()
    assert [(x.id, x.pieces, round(x.height, 6)) for x in got] == [(7, 2, 11.0)]
    assert math.isclose(got[0].share, (34 + 28) / 100, abs_tol=1e-9)


def test_enrichment_prefers_own_tags_then_one_candidate(spark):
    roads = spark.createDataFrame([(1, "10", {"name": "", "kind": "a"}), (2, "20", {"kind": "b"}), (3, "30", {}), (4, "40", {"kind": "c"})], "id long, way string, tags map<string,string>")
    cand = spark.createDataFrame([(5, ["10"], {"name": "x", "kind": "z", "gone": None}), (6, [], {"lanes": "2"}), (7, [], {"lanes": "3"})], "other long, ways array<string>, tags map<string,string>")
    along = spark.createDataFrame([(1, 6, 0.9), (2, 6, 0.86), (3, 6, 0.9), (3, 7, 0.9), (4, 6, 0.84)], "id long, other long, share double")
    got = {x.id: x for x in op.enriched(roads, cand, along).collect()}
    assert got[1].tags == {"name": "x", "kind": "a"} and got[1].origin == {"name": "5", "kind": "own"} and got[1].matches == [5]
    assert got[2].tags == {"kind": "b", "lanes": "2"} and got[2].origin["lanes"] == "6"
    assert got[3].tags == {} and got[3].matches == [6, 7] and got[4].tags == {"kind": "c"} and got[4].matches == []


def planted(spark, order):
    r = np.random.default_rng(order)
    xy = r.uniform(-1500, 1500, (400, 2))
    c = r.uniform(-2, 2, ((1, 3, 6)[order], 2))
    a, b = (xy / 1000).T
    basis = np.stack([np.ones(400), *([a, b] if order else []), *([a * a, a * b, b * b] if order > 1 else [])], axis=1)
    uv = xy + basis @ c + r.normal(0, 0.02, (400, 2))
    uv[::10] += 40
    return c, spark.createDataFrame(np.c_[xy, uv].tolist(), "x double, y double, u double, v double")


def test_planted_displacements_come_back(spark):
    for order in (0, 1, 2):
        c, pairs = planted(spark, order)
        fit = al.displacement_fit(pairs, order, (0.0, 0.0))
        assert np.abs(fit.coefficients - c).max() < 0.1, (order, fit.coefficients, c)


def test_pairing_and_fitting_in_turn(spark):
    r = np.random.default_rng(5)
    xy = np.stack([(np.arange(144) % 12) * 40.0, (np.arange(144) // 12) * 40.0], axis=1) + r.uniform(-6, 6, (144, 2))
    box = lambda p: [(i, float(x), float(y), 16.0, 14.0) for i, (x, y) in enumerate(p)]
    moved = xy - np.array([5.0, -4.0]) - (xy - xy.mean(axis=0)) @ np.array([[0.004, 0.0], [0.002, -0.003]])
    schema = "id long, x double, y double, w double, h double"
    fit, pairs = al.alternating_fit(spark.createDataFrame(box(moved), schema), spark.createDataFrame(box(xy), schema), 1, 25.0, 0.05)
    got = {x.a: x.b for x in pairs.collect()}
    assert got == {i: i for i in range(144)}
    x, y = fit.moved(F.col("x"), F.col("y"))
    back = np.array([[p.x, p.y] for p in spark.createDataFrame(box(moved), schema).orderBy("id").select(x.alias("x"), y.alias("y")).collect()])
    assert np.abs(back - xy).max() < 0.05


def test_shares_of_lines_of_any_number_of_segments(spark):
    rng = random.Random(21)
    seg = lambda: (rng.uniform(0, 6), rng.uniform(0, 6))
    rows = lambda n: [(i, s, *p, *(p[k] + rng.uniform(-3, 3) for k in (0, 1))) for i in range(n) for s in range(1 + i % 3) for p in [seg()]]
    have = op.with_positions(spark.createDataFrame(rows(20), "id long, seq long, x1 double, y1 double, x2 double, y2 double"))
    others = spark.createDataFrame([(i, *r) for i, _, *r in rows(20)], "other long, x1 double, y1 double, x2 double, y2 double")
    got = {(r.id, r.other): r.share for r in op.along_shares(have, others, 0.5, 1.0).collect()}
    assert len(got) == op.along_shares(have, others, 0.5, 1.0).count()
    for key in [(0, 0), (3, 3), (1, 0), (0, 4), (2, 5), (6, 9), (12, 15), (5, 5)]:
        line, lengths, near = [], 0.0, 0.0
        for a in have.where(f"id = {key[0]}").collect():
            lengths += a.length
            for k in range(2000):
                x, y = a.x1 + (k + 0.5) / 2000 * (a.x2 - a.x1), a.y1 + (k + 0.5) / 2000 * (a.y2 - a.y1)
                line.append((x, y, a.length / 2000))
        edges = others.where(f"other = {key[1]}").collect()
        for x, y, w in line:
            for b in edges:
                dx, dy = b.x2 - b.x1, b.y2 - b.y1
                t = min(1.0, max(0.0, ((x - b.x1) * dx + (y - b.y1) * dy) / (dx * dx + dy * dy)))
                if math.hypot(x - b.x1 - t * dx, y - b.y1 - t * dy) <= 0.5:
                    near += w
                    break
        assert abs(got.get(key, 0.0) - near / lengths) < 2e-3


def test_a_pair_of_many_common_cells_is_taken_once_without_a_distinct(spark):
    have = op.with_positions(spark.createDataFrame([(1, 0, 0.1, 0.1, 9.7, 8.3), (2, 0, 8.0, 1.0, 1.0, 8.0)], LINE))
    rings = spark.createDataFrame([(5, [(0.5, 0.4), (9.0, 0.4), (9.0, 8.9), (0.5, 8.9)])], "other long, ring array<struct<x:double,y:double>>")
    other = spark.createDataFrame([(7, 0.3, 0.2, 9.0, 8.0)], EDGE)
    for out in (op.inner_stretches(have, rings, 0.5), op.near_stretches(have, other, 1.0, 0.5)):
        assert sorted(r.id for r in out.collect()) == [1, 2]
        assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
