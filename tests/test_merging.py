"""Distance transform and grid merging against plain loops."""

import math
import random

import pytest

from cityweave.operators import merging as m


@pytest.mark.parametrize("seed, n", [(0, 5), (1, 1), (2, 40), (3, 0)])
def test_nearest_seeds(spark, seed, n):
    r = random.Random(seed)
    seeds = {(r.randrange(-4, 9), r.randrange(-6, 12)) for _ in range(n)}
    got = m.nearest_seeds((-5, 9, -7, 13), spark.createDataFrame(sorted(seeds), "row long, col long")).collect()
    assert len(got) == (15 * 21 if seeds else 0)
    for x in got:
        best = min(math.dist((x.row, x.col), s) for s in seeds)
        assert math.isclose(x.cells, best) and (x.seed_row, x.seed_col) in seeds
        assert math.isclose(math.dist((x.row, x.col), (x.seed_row, x.seed_col)), best)


def test_merged_ground(spark):
    primary = {(r, c): 10.0 + r for r in range(6) for c in range(5)}
    fallback = {(r, c): 7.0 + r + 0.1 * c for r in range(6) for c in range(3, 14)}
    frame = lambda d: spark.createDataFrame([(r, c, z) for (r, c), z in d.items()], "row long, col long, z double")
    got = {(x.row, x.col): x for x in m.merged_ground(frame(primary), frame(fallback), 10.0, 40.0, 15.0, 20.0).collect()}
    off = {k: primary[k] - fallback[k] for k in primary.keys() & fallback.keys()}
    seam = [k for k in off if any((k[0] + i, k[1] + j) not in primary for i in (-1, 0, 1) for j in (-1, 0, 1))]
    wide = [off[k] for k in off if min(math.dist(k, s) for s in seam) * 10 <= 15]
    for k, z in primary.items():
        assert (got[k].z, got[k].source) == (z, "primary")
    for k, z in fallback.items():
        if k not in primary:
            d = min(math.dist(k, s) for s in seam)
            share = min(d * 10 / 40, 1.0)
            at = min((s for s in seam if math.isclose(math.dist(k, s), d)), key=lambda s: (s[1], s[0]))
            want = z + (1 - share) * off[at] + share * sum(wide) / len(wide)
            assert math.isclose(got[k].z, want) and got[k].source == ("blended" if share < 1 else "fallback")
    known = primary.keys() | fallback.keys()
    rim = {k for k, x in got.items() if x.source == "extrapolated"}
    want = {(r, c) for r in range(-3, 9) for c in range(-3, 17) if not (0 <= r < 6 and 0 <= c < 14) and min(math.dist((r, c), k) for k in known) <= 2}
    assert rim == want
    assert m.merged_ground(frame({(0, 0): 1.0}).where("z > 5"), frame({(0, 0): 1.0}).where("z > 5"), 10.0).count() == 0


def test_saved_grids_and_snapshots(spark, tmp_path):
    from cityweave.sources import store

    cells = spark.createDataFrame([(0, 0, 1.5), (300, 2, 2.5), (-1, 700, 3.5), (5, 5, None), (6, 6, float("nan"))], "row long, col long, z double")
    store.save_grid(cells, f"{tmp_path}/g", "EPSG:1", 100.0, 50.0, 2.0, "test")
    whole, place = store.load_grid(spark, f"{tmp_path}/g", "EPSG:1")
    assert sorted(tuple(r) for r in whole.collect()) == [(-1, 700, 3.5), (0, 0, 1.5), (300, 2, 2.5)]
    assert (place["x0"], place["y0"], place["cell"], place["source"]) == (100.0, 50.0, 2.0, "test")
    part, _ = store.load_grid(spark, f"{tmp_path}/g", box=(100.0, 40.0, 110.0, 50.0))
    assert [tuple(r) for r in part.collect()] == [(0, 0, 1.5)]
    with pytest.raises(ValueError):
        store.load_grid(spark, f"{tmp_path}/g", "EPSG:2")
    store.save_snapshot(spark.createDataFrame([(1, "a"), (2, "b")], "object_id long, s string"), f"{tmp_path}/s", "x")
    assert store.load_snapshot(spark, f"{tmp_path}/s", "x").count() == 2
    with pytest.raises(ValueError):
        store.load_snapshot(spark, f"{tmp_path}/s", "y")
    store.save_snapshot(spark.createDataFrame([(1, "a"), (1, "b")], "object_id long, s string"), f"{tmp_path}/t", "x")
    with pytest.raises(ValueError):
        store.load_snapshot(spark, f"{tmp_path}/t", "x")
