"""Spatial queries: points from the first components of `embeddings`, scaled by ten; even ids against odd ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.functions import columns as fn
from cityweave.operators import spatial as op


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    c = lambda i: (F.element_at("embedding", i).cast("double") * 10)
    return e.select(F.col("vec_id").alias("id"), c(1).alias("x"), c(2).alias("y"), c(3).alias("z"))


def within(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return op.within(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 0.3).withColumn("dist", F.round("dist", 6))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return op.nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"), 0.05).withColumn("dist", F.round("dist", 6))


def in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in triangles around every tenth point."""
    p = points(spark, sf_dir)
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    tri = p.where("id % 10 = 0").select("id", F.array(corner(-0.4, -0.3), corner(0.5, -0.2), corner(0.1, 0.6)).alias("ring"))
    return op.points_in_polygons(p, tri, 0.5)


def to_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even points against segments from every odd point, each one unit long along x and half along y."""
    p = points(spark, sf_dir)
    s = p.where("id % 2 = 1").select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 1).alias("x2"), (F.col("y") + 0.5).alias("y2"))
    out = op.to_segments(p.where("id % 2 = 0"), s, 0.25)
    return out.select("id", "segment", F.round("dist", 6).alias("dist"), F.round("along", 6).alias("along"))


def ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.height_above_ground(points(spark, sf_dir), 0.5)
    return out.select("id", F.round("ground", 6).alias("ground"), F.round("height", 6).alias("height"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.cell_summary(points(spark, sf_dir), 0.5)
    return out.select("col", "row", "n", F.round("z_min", 6).alias("z_min"), F.round("z_max", 6).alias("z_max"))


WEST, NORTH, SIDE = -20.0, 20.0, 80


def classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("x", "y", "z", (F.col("id") % 7).alias("class"))


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.surface_cells(classed(spark, sf_dir), 0.5, WEST, NORTH, SIDE, SIDE)
    return out.select("row", "col", "n", F.round("z_min", 6).alias("z_min"), F.round("z_max", 6).alias("z_max"), "ground")


def surface_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.surface_coverage(op.surface_cells(classed(spark, sf_dir), 0.5, WEST, NORTH, SIDE, SIDE), SIDE, SIDE).withColumn("share", F.round("share", 6))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.class_counts(classed(spark, sf_dir))


def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places around 35.5 E, 33.9 N in metres of zone 36, and back in degrees."""
    p = points(spark, sf_dir).select("id", F.round(35.5 + F.col("x") / 10, 5).alias("lon"), F.round(33.9 + F.col("y") / 10, 5).alias("lat"))
    x, y = fn.lonlat_to_utm(F.col("lon"), F.col("lat"), 36)
    lon, lat = fn.utm_to_lonlat(F.col("x"), F.col("y"), 36)
    out = p.withColumns({"x": x, "y": y}).select("id", "x", "y", lon.alias("lon"), lat.alias("lat"))
    return out.select("id", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"), F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cell_summary(points(spark, sf_dir), 0.25).select("row", "col", F.round("z_max", 6).alias("z"))


def focal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.focal_max(grid(spark, sf_dir), 2)


def seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.seam_steps(grid(spark, sf_dir)).withColumn("step", F.round("step", 6))


def cell_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.runs(grid(spark, sf_dir))


def quadkeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("id", fn.quadkey(F.col("x") + 35, F.col("y") + 33, 12).alias("key"))


P = "p as (select vec_id as id, cast(embedding[1] as double) * 10 as x, cast(embedding[2] as double) * 10 as y, cast(embedding[3] as double) * 10 as z from embeddings)"
G = f"{P}, g as (select cast(floor(y / 0.25) as bigint) as row, cast(floor(x / 0.25) as bigint) as col, round(max(z), 6) as z from p group by 1, 2)"
DIST = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)"
DISC = ", ".join(f"({i}, {j})" for i in range(-2, 3) for j in range(-2, 3) if i * i + j * j <= 4)
TRI = [(-0.4, -0.3), (0.5, -0.2), (0.1, 0.6)]
CROSS = " + ".join(
    f"cast(((t.y + {b[1]} > a.y) <> (t.y + {c[1]} > a.y)) and a.x < (({c[0]}) - ({b[0]})) * (a.y - t.y - ({b[1]})) / (({c[1]}) - ({b[1]})) + t.x + ({b[0]}) as int)"
    for b, c in zip(TRI, TRI[1:] + TRI[:1])
)
SEG = "greatest(least(((a.x - b.x) * 1 + (a.y - b.y) * 0.5) / 1.25, 1), 0)"
SURFACE = f"s as (select cast(floor(({NORTH} - y) / 0.5) as bigint) as row, cast(floor((x - {WEST}) / 0.5) as bigint) as col, count(*) as n, min(z) as z_min, max(z) as z_max, count(*) filter (where id % 7 = 2) as ground from p group by 1, 2)"
QUERIES = {
    "spatial_within": within, "spatial_nearest": nearest, "spatial_point_in_polygon": in_polygon, "spatial_nearest_segment": to_segment,
    "grid_height_above_ground": ground, "grid_cell_summary": cells, "grid_focal_max": focal, "grid_seam_steps": seams, "grid_cell_runs": cell_runs, "geo_quadkey": quadkeys,
    "grid_surface_cells": surface, "grid_surface_coverage": surface_share, "grid_class_counts": classes, "geo_utm_both_ways": projected,
}
ORACLES = {
    "spatial_within": f"with {P} select a.id, b.id as other, round({DIST}, 6) as dist from p a join p b on a.id % 2 = 0 and b.id % 2 = 1 and {DIST} <= 0.3",
    "spatial_nearest": f"with {P}, j as (select a.id, b.id as other, {DIST} as dist from p a join p b on a.id % 2 = 0 and b.id % 2 = 1) select id, arg_min(other, (dist, other)) as other, round(min(dist), 6) as dist from j group by 1",
    "spatial_point_in_polygon": f"with {P} select a.id, t.id as polygon from p a join p t on t.id % 10 = 0 where ({CROSS}) % 2 = 1",
    "spatial_nearest_segment": f"""with {P}, j as (select a.id, b.id as segment, {SEG} as t, sqrt((a.x - b.x - {SEG}) ** 2 + (a.y - b.y - {SEG} * 0.5) ** 2) as dist from p a join p b on a.id % 2 = 0 and b.id % 2 = 1),
 r as (select *, row_number() over (partition by id order by dist, segment) as r from j where dist <= 0.25) select id, segment, round(dist, 6) as dist, round(t * sqrt(1.25), 6) as along from r where r = 1""",
    "grid_height_above_ground": f"with {P}, g as (select floor(x / 0.5) as c, floor(y / 0.5) as r, quantile_cont(z, 0.05) as ground from p group by 1, 2) select id, round(ground, 6) as ground, round(greatest(z - ground, 0), 6) as height from p join g on floor(x / 0.5) = c and floor(y / 0.5) = r",
    "grid_surface_cells": f"with {P}, {SURFACE} select row, col, n, round(z_min, 6) as z_min, round(z_max, 6) as z_max, ground from s",
    "grid_surface_coverage": f"with {P}, {SURFACE} select cast(sum(n) as bigint) as points, count(*) as cells, round(count(*) / {SIDE * SIDE}.0::double, 6) as share, cast(sum(ground) as bigint) as ground, count(*) filter (where ground > 0) as ground_cells from s",
    "grid_class_counts": "select vec_id % 7 as class, count(*) as n from embeddings group by 1",
    "geo_utm_both_ways": f"""with {P}, d as (select id, round(35.5 + x / 10, 5) as lon, round(33.9 + y / 10, 5) as lat from p), k as (select 6378137.0::double as a, 1 / (2 * 298.257223563::double - 1) as n),
 e as (select d.*, n, a / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) * 0.9996 as r, radians(lon - 33) as l, 2 * sqrt(n) / (1 + n) as q, sin(radians(lat)) as s from d, k),
 t as (select *, sinh(atanh(s) - q * atanh(q * s)) as t from e), u as (select *, atan2(t, cos(l)) as xi, atanh(sin(l) / sqrt(1 + t * t)) as eta from t),
 v as (select *, [n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16, 13 * n ** 2 / 48 - 3 * n ** 3 / 5, 61 * n ** 3 / 240] as al from u)
 select id, round(500000 + r * (eta + al[1] * cos(2 * xi) * sinh(2 * eta) + al[2] * cos(4 * xi) * sinh(4 * eta) + al[3] * cos(6 * xi) * sinh(6 * eta)), 5) as x,
 round(r * (xi + al[1] * sin(2 * xi) * cosh(2 * eta) + al[2] * sin(4 * xi) * cosh(4 * eta) + al[3] * sin(6 * xi) * cosh(6 * eta)), 5) as y, lon, lat from v""",
    "grid_cell_summary": f"with {P} select cast(floor(x / 0.5) as bigint) as col, cast(floor(y / 0.5) as bigint) as row, count(*) as n, round(min(z), 6) as z_min, round(max(z), 6) as z_max from p group by 1, 2",
    "grid_focal_max": f"with {G}, d(i, j) as (values {DISC}) select g.row, g.col, max(o.z) as z from g, d join g o on o.row = g.row + d.i and o.col = g.col + d.j group by 1, 2",
    "grid_seam_steps": f"with {G} select a.row, a.col, round(b.z - a.z, 6) as step from g a join g b on a.row = b.row and b.col = a.col + 1",
    "grid_cell_runs": f"with {G}, i as (select row, col, col - row_number() over (partition by row order by col) as k from g) select row, min(col) as first, max(col) as last from i group by row, k",
    "geo_quadkey": f"""with {P}, t as (select id, cast(floor((x + 35 + 180) / 360 * 4096) as bigint) as tx, cast(floor((1 - ln(tan(radians(y + 33)) + 1 / cos(radians(y + 33))) / pi()) / 2 * 4096) as bigint) as ty from p)
 select id, {" || ".join(f"cast((tx // {1 << b}) % 2 + 2 * ((ty // {1 << b}) % 2) as varchar)" for b in range(11, -1, -1))} as key from t""",
}
