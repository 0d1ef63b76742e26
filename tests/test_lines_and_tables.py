"""Lines, table functions, saved tables and the learned forecaster on small data, against brute force where SQL has no word."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cityweave.functions import tables
from cityweave.operators import learned, lines, rings
from cityweave.sources import store

XY = "array<struct<x: double, y: double>>"


def test_lengths_inside_a_ring_that_is_not_convex(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0)]
    polygons = spark.createDataFrame([(1, ring)], f"id long, ring {XY}")
    s = spark.createDataFrame([(1, -1.0, 2.0, 5.0, 2.0), (2, 1.0, 0.5, 3.0, 0.5), (3, 9.0, 9.0, 9.5, 9.0), (4, 2.0, 0.5, 2.0, 0.5)], "id long, x1 double, y1 double, x2 double, y2 double")
    got = {r.id: r.length for r in lines.lengths_inside(s, polygons, 1.5).collect()}
    assert got == {1: pytest.approx(2.0), 2: pytest.approx(2.0)}


def test_row_trees_against_one_pass(spark):
    rng = random.Random(3)
    samples = [(i, k, rng.random() * 3, rng.random() * 3) for i in range(12) for k in range(6)]
    trees = [(i, rng.random() * 3, rng.random() * 3) for i in range(8)]
    gap, want, near = 0.4, [], [(x, y) for _, x, y in trees]
    for i, k, x, y in sorted(samples):
        if all(math.dist((x, y), q) > gap for q in near):
            want.append((i, k))
            near.append((x, y))
    s, t = spark.createDataFrame(samples, "id long, k int, x double, y double"), spark.createDataFrame(trees, "id long, x double, y double")
    assert sorted((r.id, r.k) for r in lines.row_trees(s, t, gap).collect()) == want
    assert lines.row_trees(s.limit(0), t, gap).count() == 0


def test_line_gap_and_duplicates_in_alignment(spark):
    a, b = [(0.0, 0.0), (10.0, 0.0)], [(0.0, 0.0), (5.0, 1.0), (10.0, 0.0)]
    row = spark.createDataFrame([(a, b)], f"a {XY}, b {XY}").select(lines.line_gap(F.col("a"), F.col("b"))).first()[0]
    assert row == pytest.approx(1.0)
    lane = lambda rows: spark.createDataFrame(rows, f"id string, width double, line {XY}")
    got = {r.id: r.issues for r in lines.alignment_issues(lane([("a", 3.0, a), ("b", 3.0, a), ("d", 3.0, a)]), lane([("a", 3.2, b), ("c", 3.0, a), ("c", 3.0, a), ("d", 3.0, a)]), 0.5).collect()}
    assert got == {"a": ["width", "geometry"], "b": ["missing"], "c": ["extra", "duplicate"]}


def test_simplification_against_recursion(spark):
    def plain(p, tol):
        if len(p) <= 2:
            return p
        (ax, ay), (bx, by) = p[0], p[-1]
        dx, dy = bx - ax, by - ay
        far = []
        for x, y in p[1:-1]:
            t = min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / max(dx * dx + dy * dy, 1e-12)))
            far.append(math.hypot(x - ax - t * dx, y - ay - t * dy))
        i = int(np.argmax(far)) + 1
        return [p[0], p[-1]] if far[i - 1] <= tol else plain(p[: i + 1], tol)[:-1] + plain(p[i:], tol)

    rng = random.Random(5)
    rows = [(i, [(float(k), rng.gauss(0, 2)) for k in range(n)]) for i, n in enumerate([1, 2, 3, 9, 40, 200])]
    df = spark.createDataFrame([*rows, (99, None), (98, [])], f"id long, line {XY}")
    got = {r.id: r.s and [(p.x, p.y) for p in r.s] for r in df.select("id", tables.simplified(1.0)("line").alias("s")).collect()}
    assert got == {i: plain(p, 1.0) for i, p in rows} | {99: None, 98: []}


def test_table_functions_of_empty_lines_and_null_boxes(spark):
    tables.register(spark)
    df = spark.createDataFrame([(1, []), (2, None), (3, [(0.0, 0.0)]), (4, [(1.0, 1.0), (1.0, 1.0)]), (5, [(0.0, 0.0), (0.0, 3.0)])], f"id long, line {XY}")
    got = [tuple(r) for r in spark.sql("select id, u.* from {d}, lateral line_units(line, 3) u order by k", d=df).collect()]
    assert got == [(5, k, 0.0, pytest.approx(k), 0.0, pytest.approx(k + 1)) for k in range(3)]
    assert spark.sql("select * from box_tiles(cast(null as double), 0D, 1D, 1D, 1D)").count() == 0
    vals = spark.createDataFrame([("a", float(v)) for v in range(20)] + [("b", None)], "k string, v double")
    got = {r.k: r.m for r in vals.groupBy("k").agg(tables.trimmed_mean("v").alias("m")).collect()}
    assert got["a"] == pytest.approx(9.5) and (got["b"] is None or math.isnan(got["b"]))


def test_saved_models_csv_and_guarded_results(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None)], "id long, name string")
    store.save_model({"roads": df, "bans": df.limit(0)}, f"{tmp_path}/m", "roads/1")
    m = store.load_model(spark, f"{tmp_path}/m", "roads/1")
    assert sorted(m) == ["bans", "roads"] and m["bans"].count() == 0 and m["roads"].count() == 3
    with pytest.raises(ValueError):
        store.load_model(spark, f"{tmp_path}/m", "roads/2")
    store.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, store.read_csv(spark, f"{tmp_path}/c", "id long, name string").collect())) == [(1, "x"), (2, ""), (3, None)]
    store.guarded_write(df, f"{tmp_path}/r", "s1", "c1")
    store.guarded_write(df, f"{tmp_path}/r", "s1", "c1")
    with pytest.raises(ValueError):
        store.guarded_write(df, f"{tmp_path}/r", "s2", "c1")
    store.write_lines(df, f"{tmp_path}/j")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/j").collect())[2] == '{"id":3,"name":null}'


def test_point_export_scales_deep_colours(spark):
    cols = "x double, y double, z double, red int, green int, blue int"
    pts = spark.createDataFrame([(500000.0, 0.0, 1.5, 65535, 257, 0), (500000.0, 0.0, 2.5, 0, 0, 0)], cols)
    out, bounds = store.point_export(pts, 36)
    first = out.orderBy("z").first()
    assert (first.lon, first.lat, first.red, first.green, first.blue) == (33.0, 0.0, 255, 1, 0)
    b = bounds.first()
    assert (b.n, b.least_z, b.most_z) == (2, 1.5, 2.5)
    assert store.point_export(pts.limit(0), 36)[1].first().n == 0


def test_forest_learns_what_the_state_does_not_tell(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        grows = rng.random() < 0.4
        size = (9.0 if grows else 1.0) + rng.random() if rng.random() < 0.9 else None
        rows.append((i, "planned" if i % 2 else "active", "complete" if grows else "planned" if i % 2 else "active", 1, size, None, "new" if i > 500 else "old"))
    df = spark.createDataFrame(rows, "object_id long, current_state string, target_state string, interval_years int, size double, nothing double, kind string")
    past, future = df.where("object_id < 400"), df.where("object_id >= 400")
    forest = learned.Forest(["size", "nothing"], ["current_state", "kind"])
    scores, chosen = learned.benchmark(past, future, ["active", "complete", "planned"], forest)
    got = {r.model: r for r in scores.collect()}
    assert chosen == "forest" and got["forest"].accuracy > 0.9 and forest.numbers == ["size"]
    assert learned.refitted(past, future, ["active", "complete", "planned"], "persistence", forest) is None
    sums = forest.predict(future.withColumn("kind", F.lit("unseen"))).select(F.aggregate(F.map_values("p"), F.lit(0.0), lambda s, v: s + v)).distinct().collect()
    assert all(abs(s[0] - 1) < 1e-9 for s in sums)
    with pytest.raises(ValueError):
        learned.Forest([], ["kind"]).fit(past.limit(0))


def test_units_of_a_line_are_its_own():
    got = list(tables.LineUnits().eval([{"x": 0.0, "y": 0.0}, {"x": 3.0, "y": 4.0}], 2))
    assert got == [(0, 0.0, 0.0, 1.5, 2.0), (1, 1.5, 2.0, 3.0, 4.0)]
    assert list(tables.BoxTiles().eval(0.1, 0.1, 1.1, 0.2, 1.0)) == [(0, 0), (1, 0)]


def test_rings_close_in_one_way_only():
    a, b, c, d = (0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)
    assert rings.closed_rings([[a, b, c], [a, d, c]]) == [[a, b, c, d, a]]
    assert rings.closed_rings([[a, b], [b, c]]) is None
    assert rings.closed_rings([[a, b], [b, c], [b, d], [c, a]]) is None
    assert rings.closed_rings([[a, b], [b, a]]) is None
    assert rings.closed_rings([]) == []


def test_holes_belong_to_the_smallest_ring_around(spark):
    box = lambda x, y, h: [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h), (x - h, y - h)]
    rows = [(1, 0, "outer", box(0.0, 0.0, 9.0)), (1, 1, "", box(0.0, 0.0, 3.0)), (1, 2, "inner", box(0.0, 0.0, 1.0)), (2, 0, "outer", box(0.0, 0.0, 1.0)), (2, 1, "inner", box(5.0, 5.0, 1.0)),
            (3, 0, "inner", box(0.0, 0.0, 1.0)), (4, 0, "outer", None), (5, 0, None, box(0.0, 0.0, 1.0)), (5, 1, "label", None)]
    df = spark.createDataFrame(rows, f"relation long, seq int, role string, points {XY}")
    got = sorted((r.relation, r.polygon, r.hole) for r in rings.multipolygons(df).collect())
    assert got == [(1, 0, False), (1, 1, False), (1, 1, True), (5, 0, False)]
    assert rings.multipolygons(df.limit(0)).count() == 0
