"""Surface reviews, readings in a band, terrain in districts and the UTM series at their edges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cityweave.functions import columns as fn
from cityweave.operators import forecast, lines, people, spatial, speeds

POINTS = "x double, y double, z double, class int"


@pytest.mark.parametrize("bad", [(5.0, 1.0, 1.0, 2), (-0.1, 1.0, 1.0, 2), (1.0, 1.0, math.nan, 2), (1.0, math.inf, 1.0, 2), (1.0, 1.0, None, 2)])
def test_points_that_do_not_belong_end_the_job(spark, bad):
    p = spark.createDataFrame([(0.5, 3.5, 7.0, 2), bad], POINTS)
    with pytest.raises(Exception, match="outside the declared bounds"):
        spatial.surface_cells(p, 1.0, 0.0, 4.0, 4, 4).collect()


def test_surface_counts_rows_from_the_north(spark):
    p = spark.createDataFrame([(0.5, 3.5, 7.0, 2), (0.6, 3.4, 5.0, 6), (3.9, 0.1, -1.0, 1), (0.0, 4.0, 6.0, None)], POINTS)
    cells = spatial.surface_cells(p, 1.0, 0.0, 4.0, 4, 4)
    assert {(r.row, r.col): (r.n, r.z_min, r.z_max, r.ground) for r in cells.collect()} == {(0, 0): (3, 5.0, 7.0, 1), (3, 3): (1, -1.0, -1.0, 0)}
    assert tuple(spatial.surface_coverage(cells, 4, 4).first()) == (4, 2, 0.125, 1, 1)
    assert tuple(spatial.surface_coverage(cells.limit(0), 4, 4).first()) == (0, 0, 0.0, 0, 0)
    assert {tuple(r) for r in spatial.class_counts(p).collect()} == {(2, 1), (6, 1), (1, 1), (None, 1)}


def test_readings_in_band(spark):
    r = [(1, False, 8, s, "holdout") for s in (10.0, 20.0, 20.0, 30.0)] + [(1, False, 8, 99.0, "calibration"), (2, False, 8, 20.0, "holdout")]
    readings = spark.createDataFrame(r, "road int, weekend boolean, hour int, speed double, split string")
    scored = spark.createDataFrame([(1, False, 8, "a", 20.0, 15.0, 20.0), (1, False, 8, "b", 20.0, 5.0, 40.0), (2, False, 8, "a", None, None, None)], "road int, weekend boolean, hour int, baseline string, pred double, p10 double, p90 double")
    assert {tuple(x) for x in speeds.readings_in_band(readings, scored).collect()} == {("a", 4, 2, 0.5), ("b", 4, 4, 1.0)}


def test_terrain_in_a_diamond(spark):
    cells = spark.createDataFrame([(r, c) for r in range(2) for c in range(-70, 70)] + [(0, 0)], "row long, col long")
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    d = [(1, ring((0, -1), (1, 0), (0, 1), (-1, 0))), (2, ring((500, 0), (501, 0), (501, 1))), (3, ring((-71, 0), (71, 0), (71, 2), (-71, 2)))]
    got = {r.id: (round(r.terrain, 9), round(r.share, 9)) for r in lines.terrain_coverage(cells, 1.0, spark.createDataFrame(d, "id long, ring array<struct<x:double,y:double>>"), 10.0).collect()}
    assert got == {1: (1.0, 0.5), 2: (0.0, 0.0), 3: (280.0, round(280 / 284, 9))}


def test_utm_both_ways(spark):
    at = [(lon, lat) for lon in (-3.0, 0.0, 2.9) for lat in (-60.0, 0.0, 45.0)]
    df = spark.createDataFrame([(15 + lon, lat) for lon, lat in at], "lon double, lat double")
    for north in (True, False):
        x, y = fn.lonlat_to_utm(F.col("lon"), F.col("lat"), 33, north)
        lon, lat = fn.utm_to_lonlat(F.col("x"), F.col("y"), 33, north)
        for r in df.withColumns({"x": x, "y": y}).withColumns({"u": lon, "v": lat}).collect():
            assert abs(r.u - r.lon) < 1e-8 and abs(r.v - r.lat) < 1e-8
    one = df.where("lon = 15 and lat = 0").select(*fn.lonlat_to_utm(F.col("lon"), F.col("lat"), 33)).first()
    assert abs(one[0] - 500000) < 1e-6 and abs(one[1]) < 1e-6


@pytest.mark.parametrize("at_once", [20_000, 40])
def test_front_equals_all_pairs(spark, at_once):
    rng = random.Random(4)
    v = [[rng.randrange(60), rng.randrange(60), rng.randrange(60)] for _ in range(900)]
    v += [[i, 60 - i, 5] for i in range(60)] * 2 + [[None, 0, 0], [3, None, None]]
    plans = [(i, *map(lambda x: None if x is None else float(x), p)) for i, p in enumerate(v)]
    beats = lambda q, p: None not in q + p and all(a <= b for a, b in zip(q, p)) and q != p
    want = {i for i, p in enumerate(v) if not any(beats(q, p) for q in v)}
    df = spark.createDataFrame(plans, "id long, a double, b double, c double").repartition(5)
    got = [r.id for r in forecast.pareto(df, "id", ["a", "b", "c"], at_once).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert forecast.pareto(df.limit(0), "id", ["a", "b", "c"]).count() == 0


def test_places_of_no_road(spark):
    places = spark.createDataFrame([(1, "cafe", "A", 0.9)], "id long, category string, name string, confidence double")
    none = spark.createDataFrame([], "road long, place long")
    assert tuple(people.place_summary(none, places).first()) == (0, 0, [], 0, [])
    twice = spark.createDataFrame([(1, 1), (2, 1)], "road long, place long")
    assert tuple(people.place_summary(twice, places).first()) == (1, 0, ["cafe:1"], 0, ["A"])
