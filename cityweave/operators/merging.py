"""Merging height grids at a seam: nearest seam cells by a separable distance transform, offsets that fade by metres."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityweave.operators.iterate import kept


def _envelope(frame: pd.DataFrame) -> pd.DataFrame:
    """Of one grid row (col, up: rows to the nearest seed in the column, null for none) each cell's nearest seed column: the
    lower envelope of parabolas, one pass to build it and one to read it. Ties go to the smaller column."""
    frame = frame.sort_values("col")
    cols, up = frame["col"].to_list(), frame["up"].to_list()
    held: list[tuple[int, int]] = []  # (place, first column, in halves below it, where it is nearest)
    starts: list[float] = []
    for i, (c, u) in enumerate(zip(cols, up)):
        if u != u or u is None:
            continue
        while held:
            j = held[-1]
            meet = ((u * u + c * c) - (up[j] * up[j] + cols[j] * cols[j])) / (2 * (c - cols[j]))
            if meet > starts[-1]:
                break
            held.pop()
            starts.pop()
        starts.append(meet if held else float("-inf"))
        held.append(i)
    best, at = [], 0
    for c in cols:
        while at + 1 < len(held) and c > starts[at + 1]:
            at += 1
        best.append(cols[held[at]] if held else None)
    return frame.assign(near=pd.array(best, dtype="Int64"))[["row", "col", "near"]]


def nearest_seeds(box: tuple[int, int, int, int], seeds: DataFrame) -> DataFrame:
    """(row, col, seed_row, seed_col, cells): for every cell of a box (first row, last row, first column, last column) the
    nearest seed (row, col) and its distance in cells; ties go to the smaller column, then row. No seeds, no rows.

    Exact and in two passes: along columns the nearest seed row on either side, then along rows the envelope of what the
    columns offer. Work follows the cells of the box, not the distance; a task holds one row or one column of the grid."""
    r0, r1, c0, c1 = box
    spark = seeds.sparkSession
    cells = spark.range(r0, r1 + 1).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(c0).cast("long"), F.lit(c1).cast("long"))).alias("col"))
    marked = cells.join(seeds.select("row", "col").distinct().withColumn("_s", F.col("row")), ["row", "col"], "left")
    w = Window.partitionBy("col").orderBy("row")
    above = F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("_s", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = marked.withColumns({"_a": above, "_b": below})
    own = F.when(F.col("_b").isNull() | (F.col("row") - F.col("_a") <= F.col("_b") - F.col("row")), F.col("_a")).otherwise(F.col("_b"))
    columns = kept(both.select("row", "col", own.alias("seed_row")))
    up = columns.select("row", "col", F.abs(F.col("row") - F.col("seed_row")).cast("double").alias("up"))
    near = up.groupBy("row").applyInPandas(_envelope, "row long, col long, near long").where("near is not null")
    seed = columns.select("row", F.col("col").alias("near"), "seed_row")
    j = near.join(seed, ["row", "near"])
    far = F.sqrt((F.col("row") - F.col("seed_row")) ** 2 + (F.col("col") - F.col("near")) ** 2)
    return j.select("row", "col", "seed_row", F.col("near").alias("seed_col"), far.alias("cells"))


def _box(df: DataFrame) -> tuple[int, int, int, int] | None:
    b = df.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    return None if b[0] is None else tuple(b)


def merged_ground(primary: DataFrame, fallback: DataFrame, cell: float, fade: float = 60.0, window: float = 150.0, rim: float = 0.0) -> DataFrame:
    """(row, col, z, source): primary (row, col, z) untouched where known; elsewhere fallback moved by an offset that is the
    difference at the nearest seam cell (a known cell of both next to a cell the primary lacks) and turns, over `fade` metres
    from the seam, into the mean difference of the common cells within `window` metres of it. Sources are primary, blended,
    fallback, and extrapolated: cells beyond both extents that take the nearest known value up to `rim` metres away."""
    p, f = (kept(d.where("z is not null and not isnan(z)").select("row", "col", "z")) for d in (primary, fallback))
    every = kept(p.select("row", "col").unionAll(f.select("row", "col")).distinct())
    box = _box(every)
    if box is None:
        return p.select("row", "col", "z", F.lit("primary").alias("source"))
    common = p.join(f.withColumnRenamed("z", "_f"), ["row", "col"]).select("row", "col", (F.col("z") - F.col("_f")).alias("off"))
    step = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    around = p.select("row", "col", step.alias("_i")).select("row", "col", "_i", step.alias("_j"))
    around = around.select("row", "col", (F.col("row") + F.col("_i")).alias("_r"), (F.col("col") + F.col("_j")).alias("_c"))
    lacking = around.join(p.select(F.col("row").alias("_r"), F.col("col").alias("_c")), ["_r", "_c"], "left_anti").select("row", "col").distinct()
    seam = kept(common.join(lacking, ["row", "col"], "left_semi"))
    near = kept(nearest_seeds(box, seam))
    wide = common.join(near.where(F.col("cells") * cell <= window).select("row", "col"), ["row", "col"], "left_semi")
    regional = F.broadcast(wide.agg(F.avg("off").alias("_g")))  # one row
    local = seam.select(F.col("row").alias("seed_row"), F.col("col").alias("seed_col"), "off")
    at = near.join(local, ["seed_row", "seed_col"]).select("row", "col", "off", (F.col("cells") * cell).alias("_d"))
    rest = f.join(p.select("row", "col"), ["row", "col"], "left_anti").join(at, ["row", "col"], "left").crossJoin(regional)
    share = F.least(F.col("_d") / max(fade, cell), F.lit(1.0))
    moved = F.col("z") + F.coalesce((1 - share) * F.col("off") + share * F.col("_g"), F.lit(0.0))
    rest = rest.select("row", "col", moved.alias("z"), F.when(share < 1, "blended").otherwise("fallback").alias("source"))
    out = p.select("row", "col", "z", F.lit("primary").alias("source")).unionAll(rest)
    n = int(rim // cell)
    if n:
        out = kept(out)
        inside = [_box(d) for d in (p, f)]
        more = nearest_seeds((box[0] - n, box[1] + n, box[2] - n, box[3] + n), every).where(F.col("cells") * cell <= rim)
        for b in inside:
            if b is not None:
                more = more.where(~(F.col("row").between(b[0], b[1]) & F.col("col").between(b[2], b[3])))
        known = out.select(F.col("row").alias("seed_row"), F.col("col").alias("seed_col"), "z")
        more = more.join(known, ["seed_row", "seed_col"]).select("row", "col", "z", F.lit("extrapolated").alias("source"))
        out = out.unionAll(more)
    return out
