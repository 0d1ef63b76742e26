import random

import numpy as np

from cityweave.operators import evidence, impact, peaks, polygons

RING = "id int, ring array<struct<x:double,y:double>>"


def square(x, y, s=10.0):
    x, y = float(x), float(y)
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_overlap_area_of_concave_rings():
    ell = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)
    box = np.array([(0.5, 0.5), (3, 0.5), (3, 3), (0.5, 3)], float)
    assert abs(polygons.overlap_area(ell, box) - (2.5 * 0.5 + 0.5 * 2)) < 1e-9
    assert abs(polygons.overlap_area(ell[::-1], box) - 2.25) < 1e-9 and polygons.overlap_area(ell, box + 10) == 0


def test_owner_and_iou(spark):
    a = spark.createDataFrame([(1, square(0, 0)), (2, square(100, 100)), (3, square(8, 0))], RING)
    b = spark.createDataFrame([(10, square(5, 0)), (11, square(-7, 0)), (12, square(50, 50))], RING)
    p = polygons.overlaps(a, b, 4.0).cache()
    assert {(r.a, r.b): round(r.area, 6) for r in p.collect()} == {(1, 10): 50.0, (1, 11): 30.0, (3, 10): 70.0}
    assert {(r.a, r.b) for r in polygons.owner_by_overlap(p).collect()} == {(1, 10), (3, 10)}
    assert [r.id for r in polygons.without_overlapping(a, p).collect()] == [2]
    assert abs(polygons.mean_best_iou(a, p).first()[0] - (50 / 150 + 0 + 70 / 130) / 3) < 1e-9
    bad = spark.createDataFrame([(1, None), (2, []), (3, square(0, 0)), (4, [*square(0, 0), (0.0, 0.0)]), (5, [(0.0, 0.0)] * 4)], RING)
    assert {r.id: r.i for r in bad.select("id", polygons.ring_issue().alias("i")).collect()} == {1: "missing", 2: "empty", 3: "open", 4: None, 5: "flat"}


def test_peaks_equal_the_greedy_pass(spark):
    rng = random.Random(3)
    z = {(r, c): float(rng.randrange(1, 12)) for r in range(18) for c in range(15)}
    got = {(r.row, r.col) for r in peaks.find_peaks(spark.createDataFrame([(r, c, v) for (r, c), v in z.items()], "row long, col long, z double"), 4.0, 3.0).collect()}
    top = [p for p, v in z.items() if v >= 4 and all(v >= z.get((p[0] + i, p[1] + j), 0) for i in (-1, 0, 1) for j in (-1, 0, 1) if i * i + j * j <= 1)]
    want = []
    for p in sorted(top, key=lambda p: (-z[p], p)):
        if all((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 >= 9 for q in want):
            want.append(p)
    assert got == set(want)


def test_impact_of_a_closure(spark):
    e = spark.createDataFrame([(1, 2, 1.0, 100.0), (2, 3, 1.0, 100.0), (1, 3, 5.0, 100.0), (3, 4, 1.0, 100.0)], "src long, dst long, cost double, capacity double")
    t = spark.createDataFrame([(1, 3, 10), (3, 4, 5), (1, 2, 2)], "origin long, dest long, n long")
    d = spark.createDataFrame([(1, 2, True, 1.0)], "src long, dst long, closed boolean, factor double")
    r = impact.impact(e, t, d, rounds=2).first()
    assert r.trips == 17 and r.cut_off == 2 and abs(r.mean_delay - 30 / 15) < 0.01


def test_evidence(spark):
    s = spark.sql("""select * from values ('a', date'2020-01-01', null, array('b', 'zz'), true, 'survey'), ('b', date'2019-01-01', date'2021-01-01', array(), false, 'map') as t(id, effective_from, effective_until, supersedes, verified, kind)""")
    c = spark.sql("select * from values ('a', date'2019-06-01'), ('b', date'2022-01-01'), ('q', date'2022-01-01') as t(source_id, on)")
    got = {r.source_id: list(r.problems) for r in evidence.citation_problems(c, s).collect()}
    assert got == {"a": ["not yet in force"], "b": ["expired", "superseded by a", "not verified"], "q": ["unknown source"]}
    assert [tuple(r) for r in evidence.dangling_references(s).collect()] == [("a", "zz")]
    claims = spark.sql("select * from values ('e', 'width', 'surveyed', array('b')), ('e', 'lanes', 'unknown', array('a')), ('e', 'kerb', 'mapped', array('b')), ('f', 'x', 'guess', array('a')) as t(entity, field, status, source_ids)")
    assert {(r.entity, r.field): r.issue for r in evidence.field_issues(claims, s).collect()} == {("e", "width"): "no survey", ("e", "lanes"): "unknown with a source", ("f", "x"): "status not allowed"}
