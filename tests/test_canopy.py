"""Crowns and canopy products against loops over the same cells."""

import math
import random

from cityweave.operators import canopy, peaks

CELLS = "row long, col long, z double"


def crowns_by_hand(z, least, spacing):
    """Flat tops by flood fill, the cell nearest their centre, then one pass from high to low."""
    known = {p: v for p, v in z.items() if v is not None and not math.isnan(v)}
    half = max(spacing / 2, 1.0)
    reach = range(-int(half), int(half) + 1)
    disc = [(i, j) for i in reach for j in reach if i * i + j * j <= half * half]
    tops = {p for p, v in known.items() if v >= least and all(known.get((p[0] + i, p[1] + j), 0) <= v for i, j in disc)}
    found, left = [], set(tops)
    for start in sorted(tops):
        if start not in left:
            continue
        group, todo = [], [start]
        left.discard(start)
        while todo:
            r, c = todo.pop()
            group.append((r, c))
            for q in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.discard(q)
                    todo.append(q)
        mr, mc = sum(r for r, _ in group) / len(group), sum(c for _, c in group) / len(group)
        best = min(group, key=lambda p: ((p[0] - mr) ** 2 + (p[1] - mc) ** 2, p))
        found.append((-known[best], start, best))
    out = []
    for _, _, p in sorted(found):
        if all(math.dist(p, q) > 0.999 * spacing for q in out):
            out.append(p)
    return set(out)


def test_crowns_equal_flood_fill_and_one_pass(spark):
    for seed, levels, spacing in ((1, 3, 2.0), (2, 6, 3.0), (3, 12, 4.5)):
        rng = random.Random(seed)
        z = {(r, c): rng.choice([None, math.nan, 0.0]) if rng.random() < 0.1 else float(rng.randrange(1, levels + 1)) for r in range(20) for c in range(17)}
        got = peaks.crown_tops(spark.createDataFrame([(*p, v) for p, v in z.items()], CELLS), 2.0, spacing).collect()
        assert {(r.row, r.col) for r in got} == crowns_by_hand(z, 2.0, spacing)
        assert all(r.z == z[r.row, r.col] for r in got)


def test_a_wide_flat_top_counts_once(spark):
    z = [(0, c, 5.0) for c in range(101)] + [(r, 0, 5.0) for r in range(1, 3)]
    got = peaks.crown_tops(spark.createDataFrame(z, CELLS), 2.0, 2.0).collect()
    assert [(r.row, r.col) for r in got] == [(0, 49)]


def test_no_canopy_at_all(spark):
    none = spark.createDataFrame([(0, 0, None), (0, 1, math.nan), (0, 2, 1.0)], CELLS)
    assert peaks.crown_tops(none, 2.0, 2.0).count() == 0
    assert peaks.crown_tops(none.limit(0), 2.0, 2.0).count() == 0


def test_tree_off_the_grid_has_no_height(spark):
    grid = spark.createDataFrame([(0, 0, None), (0, 1, 7.0), (0, 2, 3.0)], CELLS)
    trees = spark.createDataFrame([(1, 0.5, 0.5), (2, 5.5, 0.5), (3, 2.5, 0.5)], "id long, x double, y double")
    tops = spark.createDataFrame([("0:1", 1.5, 0.5)], "id string, x double, y double")
    got = {r.id: (r.height, r.candidate_dist) for r in canopy.tree_heights(grid, 1.0, trees, tops, 1.0, 1.0).collect()}
    assert got == {1: (7.0, 1.0), 2: (None, 4.0), 3: (7.0, 1.0)}


def test_cover_counts_valid_samples_only(spark):
    grid = spark.createDataFrame([(0, 0, None), (0, 1, 0.0), (0, 2, 0.0), (0, 3, 0.0), (0, 4, 9.0)], CELLS)
    samples = spark.createDataFrame([(1, 0.5, 0.5), (1, 1.5, 0.5), (1, 3.5, 0.5), (1, 4.5, 0.5), (2, 9.5, 0.5)], "id long, x double, y double")
    got = {r.id: (r.samples, r.valid_share, r.cover) for r in canopy.road_cover(samples, grid, 1.0, 3.0, 1.0).collect()}
    assert got == {1: (4, 0.75, 0.6667), 2: (1, 0.0, None)}


def test_more_room_leaves_fewer_crowns(spark):
    rng = random.Random(5)
    grid = spark.createDataFrame([(r, c, rng.uniform(0, 20)) for r in range(15) for c in range(15)], CELLS)
    corner = lambda x, y: {"x": x, "y": y}
    area = spark.createDataFrame([(1, [corner(0.0, 0.0), corner(10.0, 0.0), corner(10.0, 10.0), corner(0.0, 10.0)])], "id long, ring array<struct<x:double,y:double>>")
    rows = canopy.count_by_spacing(grid, 1.0, area, 3.0, [2.0, 4.0, 6.0], 5.0).collect()
    z = {(r.row, r.col): r.z for r in grid.collect()}
    assert {r.spacing: r.crowns for r in rows} == {s: sum(r < 10 and c < 10 for r, c in crowns_by_hand(z, 3.0, s)) for s in (2.0, 4.0, 6.0)}


def test_a_crown_on_the_edge_of_the_area_is_not_inside(spark):
    z = {(r, c): 9.0 if (r, c) in ((0, 0), (0, 4), (4, 0), (4, 4), (2, 2)) else 1.0 for r in range(5) for c in range(5)}
    grid = spark.createDataFrame([(*p, v) for p, v in z.items()], CELLS)
    corner = lambda x, y: {"x": x, "y": y}
    area = spark.createDataFrame([(1, [corner(0.5, 0.5), corner(4.5, 0.5), corner(4.5, 4.5), corner(0.5, 4.5)]), (2, [corner(-4.0, 5.0), corner(5.0, -4.0), corner(5.0, -5.0), corner(-4.0, -5.0)])], "id long, ring array<struct<x:double,y:double>>")
    assert [r.id for r in canopy.tops_in_area(grid, 1.0, area, 3.0, 2.0, 2.0).collect()] == ["2:2"]
