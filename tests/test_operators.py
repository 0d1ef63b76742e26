"""Operators against hand-checked numbers, brute force and planted parameters."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cityweave.functions import columns as fn
from cityweave.operators import audit, forecast, matching, network, osm, panel, questions, spatial, stats, windows


def test_one_to_one_equals_the_greedy_pass(spark):
    rng = random.Random(2)
    rows = [(a, b, float(rng.randrange(6))) for a in range(15) for b in range(12) if rng.random() < 0.5]
    got = {(r.a, r.b) for r in matching.one_to_one(spark.createDataFrame(rows, "a long, b long, score double")).collect()}
    want, ua, ub = set(), set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in ua and b not in ub:
            want.add((a, b))
            ua.add(a)
            ub.add(b)
    assert got == want


def test_similarity_fit_recovers_a_planted_transform(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        x, y = rng.uniform(-100, 100), rng.uniform(-100, 100)
        u, v = 0.99 * x - 0.05 * y + 3, 0.05 * x + 0.99 * y - 2
        if i % 20 == 0:
            u += 40
        rows.append((x, y, u + rng.gauss(0, 0.05), v + rng.gauss(0, 0.05)))
    fit = stats.similarity_fit(spark.createDataFrame(rows, "x double, y double, u double, v double"), rounds=12)
    assert all(abs(fit[k] - w) < t for k, w, t in (("a", 0.99, 0.002), ("b", 0.05, 0.002), ("tx", 3, 0.2), ("ty", -2, 0.2)))


def test_rollout_is_the_same_in_any_partitioning_and_moves_with_levers(spark):
    labels = ["active", "complete", "unknown"]
    m = panel.transition_matrix(spark.createDataFrame([(1, "active", "complete")] * 6 + [(1, "active", "active")] * 4 + [(1, "complete", "complete")] * 9, "interval_years int, current_state string, target_state string"), labels)
    obj = spark.range(400).select(F.col("id").alias("object_id"), F.lit("active").alias("state"))
    run = lambda d, **k: {(r.draw, r.step, r.object_id): r.state for r in forecast.rollout(d, m, labels, 2, 3, **k).collect()}
    a, b = run(obj.repartition(1)), run(obj.repartition(7))
    assert a == b
    share = sum(s == "complete" for (d, t, _), s in a.items() if t == 1) / 1200
    assert abs(share - 6.5 / 11.5) < 0.06
    push = obj.select("object_id", F.lit(1).alias("step"), F.lit("complete").alias("target_state"), F.lit(3.0).alias("delta"))
    moved = run(obj, levers=push)
    assert sum(s == "complete" for (d, t, _), s in moved.items() if t == 1) / 1200 > share + 0.2


def test_temperature_sharpens_timid_forecasts(spark):
    rows = [([0.6, 0.4], 0)] * 95 + [([0.6, 0.4], 1)] * 5
    assert stats.temperature(spark.createDataFrame(rows, "p array<double>, target int")) < 0.6


def test_turn_bans_and_ways(spark):
    roads = spark.createDataFrame([(0, 10, 1, 2), (1, 11, 2, 3), (2, 12, 2, 4), (3, 13, 2, 5)], "road int, way int, u int, v int")
    rel = "id int, restriction string, from_way int, via int, to_way int"
    no = osm.turn_bans(spark.createDataFrame([(1, "no_left_turn", 10, 2, 11)], rel), roads)
    only = osm.turn_bans(spark.createDataFrame([(1, "only_straight_on", 10, 2, 11)], rel), roads)
    assert {tuple(r) for r in no.collect()} == {(0, 1)} and {tuple(r) for r in only.collect()} == {(0, 2), (0, 3)}
    ways = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 9])], "id int, nodes array<int>")
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 1.0)], "id int, lon double, lat double")
    got = osm.way_points(ways, nodes).collect()
    assert [(r.id, [tuple(p) for p in r.points]) for r in got] == [(1, [(0.0, 0.0), (1.0, 0.0), (2.0, 1.0)])]


def test_road_attributes(spark):
    rows = [(1, {"highway": "primary", "lanes": "4"}), (2, {"highway": "residential", "oneway": "-1", "bridge": "yes"}), (3, {"highway": "motorway", "lanes": "3", "layer": "2", "ref": "A1"})]
    out = {r.id: r for r in osm.road_attributes(spark.createDataFrame(rows, "id int, tags map<string,string>"), {"residential": 1}).collect()}
    assert [(out[i].oneway, out[i].lanes, out[i].level) for i in (1, 2, 3)] == [(0, 2, 0), (-1, 1, 1), (1, 3, 2)] and out[3].name == "A1"


def test_split_at_junctions(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [9, 3, 8])], "way int, nodes array<int>")
    got = {}
    for r in network.split_at_junctions(ways).orderBy("way", "piece", "seq").collect():
        got.setdefault((r.way, r.piece), []).append(r.node)
    assert sorted(got.values()) == [[1, 2, 3], [3, 4], [3, 8], [9, 3]]


def test_edge_loads_follow_the_tree(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0)], "src long, dst long, cost double")
    paths = network.shortest(e, spark.createDataFrame([(1,)], "origin long"))
    trips = spark.createDataFrame([(1, 4, 10), (1, 2, 3)], "origin long, dest long, n long")
    assert {(r.src, r.dst): r["load"] for r in network.edge_loads(paths, trips).collect()} == {(1, 2): 13, (2, 3): 10, (3, 4): 10}


def test_utm_round_numbers(spark):
    lon, lat = fn.utm_to_lonlat(F.lit(500000.0), F.lit(4649776.22), 33)
    r = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert abs(r.lon - 15.0) < 1e-9 and abs(r.lat - 42.0) < 1e-5


def test_small_functions(spark):
    df = spark.createDataFrame([("2.5 m", "x"), ("wide", "nan"), (None, "-1")], "a string, b string")
    got = df.select(fn.metres("a", 1.0, 10).alias("m"), fn.number("b").alias("n")).collect()
    assert [r.m for r in got] == [2.5, 1.0, 1.0] and [r.n for r in got] == [None, None, None]
    d = spark.createDataFrame([(350.0, 10.0), (10.0, 190.0)], "a double, b double").select(fn.angle_delta(F.col("a"), F.col("b")).alias("d"))
    assert [r.d for r in d.collect()] == [-20.0, 180.0]
    p = spark.createDataFrame([([0.2, 0.3, 0.5], u) for u in (0.1, 0.2, 0.49, 0.5, 0.999)], "p array<double>, u double")
    assert [r.i for r in p.select(fn.pick(F.col("p"), F.col("u")).alias("i")).collect()] == [0, 1, 1, 2, 2]


def test_leakage_and_intervals(spark):
    p = spark.createDataFrame([(1, 2018, 2017), (2, 2018, 2020)], "id int, start_year int, permit int")
    out = {r.id: (r.since, r.since_known) for r in panel.point_in_time(p, "permit", "start_year", "since").collect()}
    assert out == {1: (1, 1), 2: (None, 0)}
    with pytest.raises(ValueError):
        panel.assert_no_leakage(p, ["permit"])
    with pytest.raises(ValueError):
        panel.select_interval(p.withColumn("target_year", F.lit(2022)), 2018, 2024)


def test_gate():
    s = {"persistence": {"macro_f1": 0.4, "brier": 0.38}, "markov": {"macro_f1": 0.4, "brier": 0.28}, "trees": {"macro_f1": 0.39, "brier": 0.2}}
    assert panel.gate(s, "trees") == "markov"
    assert panel.gate(s | {"trees": {"macro_f1": 0.5, "brier": 0.2}}, "trees") == "trees"


def test_admission_spacing_and_digest(spark):
    g = spark.createDataFrame([("k", 1, 6), ("k", 2, 5), ("k", 3, 4)], "k string, o int, n int")
    assert [r.o for r in windows.admit_whole(g, "k", "o", "n", 10).orderBy("o").collect()] == [1, 3]
    w = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 1.0), ("k", 3, 2.0)], "k string, o int, at double")
    assert [r.o for r in matching.spaced(w, "k", "o", "at", 1.5).orderBy("o").collect()] == [1, 3]
    a, b = audit.table_digest(w.repartition(1)).first(), audit.table_digest(w.repartition(5).orderBy(F.rand())).first()
    assert a == b and a.rows == 3 and a != audit.table_digest(w.unionAll(w.limit(1))).first()


def test_nearest_without_candidates(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    assert spatial.nearest(a, a.where("id > 5"), 1.0, rings=3).first().other is None
    assert math.isclose(spatial.nearest(a, spark.createDataFrame([(7, 3.0, 4.0)], "id int, x double, y double"), 1.0).first().dist, 5.0)


def test_question_issues(spark):
    o = spark.createDataFrame([(1, "north", "home", 3.0)], "object_id int, sector string, use string, size double")
    q = questions.Question("rank", "size", {"use": ("Home", "castle")})
    assert questions.issues(q, o) == ["unknown use castle"] and questions.answer(q, o).count() == 1
