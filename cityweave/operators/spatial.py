"""Spatial joins as cell equi-joins with an exact filter, so that no pair outside neighbouring cells is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions.columns import inside_ring, on_ring
from cityweave.operators.iterate import kept


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def _around(df: DataFrame, size: float) -> DataFrame:
    near = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return df.withColumn("_d", F.explode(F.array(*near))).withColumns(
        {"_cx": _cell(F.col("x"), size) + F.col("_d.i"), "_cy": _cell(F.col("y"), size) + F.col("_d.j")}
    ).drop("_d")


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs (id, other, dist) of points (id, x, y) at most radius apart; right is copied to the cells around."""
    a = left.select("id", "x", "y", _cell(F.col("x"), radius).alias("_cx"), _cell(F.col("y"), radius).alias("_cy"))
    b = _around(right.select("id", "x", "y"), radius).select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "_cx", "_cy")
    d = F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2)
    return a.join(b, ["_cx", "_cy"]).withColumn("dist", d).where(F.col("dist") <= radius).select("id", "other", "dist")


def nearest(left: DataFrame, right: DataFrame, start: float, rings: int = 12) -> DataFrame:
    """(id, other, dist) of each left point's nearest right point, the smaller id on ties.

    Radii double from `start`; points that have found one leave. Points without any after the last radius get null."""
    found, rest = None, left.select("id", "x", "y")
    radius = start
    for _ in range(rings):
        hit = within(rest, right, radius).groupBy("id").agg(F.min(F.struct("dist", "other")).alias("m")).select("id", "m.other", "m.dist")
        hit = kept(hit)
        found = hit if found is None else found.unionAll(hit)
        rest = kept(rest.join(hit, "id", "left_anti"))
        if rest.isEmpty():
            break
        radius *= 2
    none = rest.select("id", F.lit(None).cast(dict(right.dtypes)["id"]).alias("other"), F.lit(None).cast("double").alias("dist"))
    return found.unionAll(none)


def points_in_polygons(points: DataFrame, polygons: DataFrame, size: float, strict: bool = False) -> DataFrame:
    """(id, polygon) for points (id, x, y) inside polygons (id, ring array<struct<x,y>>); a polygon is copied to the
    cells of its bounding box. A point on an edge is inside one of two polygons that share it, or with strict inside none."""
    lo = lambda k: F.array_min(F.transform("ring", lambda p: p[k]))
    hi = lambda k: F.array_max(F.transform("ring", lambda p: p[k]))
    span = lambda k: F.explode(F.sequence(_cell(lo(k), size), _cell(hi(k), size)))
    cells = polygons.select(F.col("id").alias("polygon"), "ring", span("x").alias("_cx")).select("polygon", "ring", "_cx", span("y").alias("_cy"))
    p = points.select("id", "x", "y", _cell(F.col("x"), size).alias("_cx"), _cell(F.col("y"), size).alias("_cy"))
    at = F.col("x"), F.col("y"), F.col("ring")
    return p.join(cells, ["_cx", "_cy"]).where(inside_ring(*at) & ~on_ring(*at) if strict else inside_ring(*at)).select("id", "polygon")


def to_segments(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """(id, segment, dist, along): each point's nearest segment (id, x1, y1, x2, y2) within radius, and where on it."""
    size = radius
    lo = lambda a, b: _cell(F.least(a, b) - radius, size)
    hi = lambda a, b: _cell(F.greatest(a, b) + radius, size)
    s = segments.withColumn("_cx", F.explode(F.sequence(lo("x1", "x2"), hi("x1", "x2")))).withColumn("_cy", F.explode(F.sequence(lo("y1", "y2"), hi("y1", "y2"))))
    s = s.withColumnRenamed("id", "segment")
    p = points.select("id", "x", "y", _cell(F.col("x"), size).alias("_cx"), _cell(F.col("y"), size).alias("_cy"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx**2 + dy**2
    t = F.coalesce(F.least(F.greatest(((F.col("x") - F.col("x1")) * dx + (F.col("y") - F.col("y1")) * dy) / F.nullif(length, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    j = p.join(s, ["_cx", "_cy"]).withColumn("t", t)
    gap = F.sqrt((F.col("x") - F.col("x1") - F.col("t") * dx) ** 2 + (F.col("y") - F.col("y1") - F.col("t") * dy) ** 2)
    j = j.withColumns({"dist": gap, "along": F.col("t") * F.sqrt(length)}).where(F.col("dist") <= radius)
    best = Window.partitionBy("id").orderBy("dist", "segment")
    return j.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("id", "segment", "dist", "along")


def disc(radius: float) -> list[Column]:
    """Offsets (i, j) of the cells whose centres are within so many cells."""
    reach = range(-int(radius), int(radius) + 1)
    return [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in reach for j in reach if i * i + j * j <= radius * radius]


def nearest_line(points: DataFrame, segments: DataFrame, start: float, rings: int = 12) -> DataFrame:
    """(id, dist) of each point's nearest segment (id, x1, y1, x2, y2), as `nearest` finds points; null beyond the last radius."""
    found, rest = None, points.select("id", "x", "y")
    for k in range(rings):
        hit = kept(to_segments(rest, segments, start * 2**k).select("id", "dist"))
        found = hit if found is None else found.unionAll(hit)
        rest = kept(rest.join(hit, "id", "left_anti"))
        if rest.isEmpty():
            break
    return found.unionAll(rest.select("id", F.lit(None).cast("double").alias("dist")))


def focal_max(cells: DataFrame, radius: float) -> DataFrame:
    """(row, col, z): the largest z within a disc of so many cells."""
    spread = cells.select("row", "col", "z", F.explode(F.array(*disc(radius))).alias("d"))
    near = spread.groupBy((F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col")).agg(F.max("z").alias("z"))
    return cells.select("row", "col").join(near, ["row", "col"])


def height_above_ground(points: DataFrame, size: float, q: float = 0.05) -> DataFrame:
    """Points (id, x, y, z) with ground, the low quantile of their cell, and height, not below zero."""
    cell = points.withColumns({"_cx": _cell(F.col("x"), size), "_cy": _cell(F.col("y"), size)})
    ground = cell.groupBy("_cx", "_cy").agg(F.percentile("z", q).alias("ground"))
    return cell.join(ground, ["_cx", "_cy"]).withColumn("height", F.greatest(F.col("z") - F.col("ground"), F.lit(0.0))).drop("_cx", "_cy")


def cell_summary(points: DataFrame, size: float) -> DataFrame:
    """Count, least and largest z of each cell."""
    return points.groupBy(_cell(F.col("x"), size).alias("col"), _cell(F.col("y"), size).alias("row")).agg(
        F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max")
    )


def surface_cells(points: DataFrame, size: float, west: float, north: float, rows: int, cols: int, ground: int = 2) -> DataFrame:
    """(row, col, n, z_min, z_max, ground) of points (x, y, z, class) on a grid that starts at its north-west corner: count,
    least and largest height and the number of points labelled as ground. Points that are not finite or outside the declared
    grid end the job with an error, since a surface without them would look whole."""
    row, col = F.floor((north - F.col("y")) / size), F.floor((F.col("x") - west) / size)
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    good = finite("x") & finite("y") & finite("z") & row.between(0, rows - 1) & col.between(0, cols - 1)
    bad = F.raise_error(F.lit("a point is not finite or outside the declared bounds")).cast("double")
    p = points.select(row.alias("row"), col.alias("col"), F.when(F.coalesce(good, F.lit(False)), F.col("z")).otherwise(bad).alias("z"), "class")
    return p.groupBy("row", "col").agg(F.count("*").alias("n"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count_if(F.col("class") == ground).alias("ground"))


def surface_coverage(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """One row: points, cells with any, their share of the grid, ground points and the cells that hold some."""
    share = F.count("*") / float(rows * cols)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return cells.agg(total("n").alias("points"), F.count("*").alias("cells"), share.alias("share"), total("ground").alias("ground"), F.count_if(F.col("ground") > 0).alias("ground_cells"))


def class_counts(points: DataFrame) -> DataFrame:
    """(class, n) of the classes that occur."""
    return points.groupBy("class").agg(F.count("*").alias("n"))


def seam_steps(cells: DataFrame) -> DataFrame:
    """(row, col, step): height difference to the next cell of the row, where that is adjacent."""
    w = Window.partitionBy("row").orderBy("col")
    nxt = F.lead("col").over(w)
    return cells.withColumns({"_n": nxt, "_z": F.lead("z").over(w)}).where(F.col("_n") == F.col("col") + 1).select("row", "col", (F.col("_z") - F.col("z")).alias("step"))


def runs(cells: DataFrame) -> DataFrame:
    """(row, first, last): maximal runs of neighbouring cells in each row."""
    w = Window.partitionBy("row").orderBy("col")
    return cells.withColumn("_g", F.col("col") - F.row_number().over(w)).groupBy("row", "_g").agg(F.min("col").alias("first"), F.max("col").alias("last")).drop("_g")
