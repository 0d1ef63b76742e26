"""Canopy queries: a height grid, mapped trees, rows of trees, footprints and flights from `embeddings`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.operators import canopy as op
from cityweave.plans.grids import rounded
from cityweave.plans.lines import segments, square
from cityweave.plans.more import P
from cityweave.plans.spatial import points

SIZE, LEAST, SPACING, BUFFER, FAR, RADIUS, REACH = 0.25, 0.5, 1.0, 0.5, 0.3, 0.6, 0.5


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest height of each cell; every ninth cell, by row and column, is known to the grid but has no data."""
    p = points(spark, sf_dir)
    g = p.groupBy(F.floor(F.col("y") / SIZE).alias("row"), F.floor(F.col("x") / SIZE).alias("col")).agg(F.round(F.max("z"), 6).alias("z"))
    return g.withColumn("z", F.when(F.pmod(F.col("row") * 7 + F.col("col"), F.lit(9)) != 0, F.col("z")))


def made(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p, s = points(spark, sf_dir), segments(spark, sf_dir)
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    area = spark.range(1).select("id", F.array(corner(3.0, 0.0), corner(0.0, 3.0), corner(-3.0, 0.0), corner(0.0, -3.0)).alias("ring"))
    flights = p.where("id % 10 = 3").select("id", square(F.col("x"), F.col("y"), 0.7).alias("ring"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 97).cast("int")).alias("date"))
    step = F.explode(F.sequence(F.lit(0), F.lit(4)))
    samples = s.select("id", "x1", "y1", step.alias("k")).select("id", (F.col("x1") + F.col("k") * 0.25).alias("x"), (F.col("y1") + F.col("k") * 0.125).alias("y"))
    return op.products(
        cells(spark, sf_dir), SIZE, area, p.where("id % 5 = 0"), s.where("id % 11 = 0"), p.where("id % 10 = 1").select("id", square(F.col("x"), F.col("y"), 0.2).alias("ring")),
        flights, s.select("id", (50 + F.col("id") % 7).cast("double").alias("length")), samples, LEAST, SPACING, BUFFER, FAR, RADIUS, REACH, unit=0.1,
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = made(spark, sf_dir)["candidates"]
    return rounded(c.select("id", "height", "date", "tree_dist", "row_dist", "unmapped", "on_footprint"), ("id", "date", "unmapped", "on_footprint"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(made(spark, sf_dir)["trees"].select("id", "height", "candidate_dist"), ("id",))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir)["summary"]


def greenest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cover = made(spark, sf_dir)["cover"]
    return op.greenest(cover.select("id", "length"), cover.drop("length")).select("id", "length", "samples", "valid_share", "cover")


#: Taking and dropping by hand as often as the tables need at all sizes given; the operator goes on until nothing is left.
ROUNDS = 8
_better = "(b.z > a.z or (b.z = a.z and (b.row, b.col) < (a.row, a.col)))"
_near = "(a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 15"
_rounds = ", ".join(
    f"k{i} as materialized (select * from l{i} a where not exists (select 1 from l{i} b where {_near} and {_better})), "
    f"l{i + 1} as materialized (select * from l{i} a where not exists (select 1 from k{i} b where {_near}))"
    for i in range(ROUNDS)
)
_along = "greatest(0, least(1, ((c.x - r.x) + (c.y - r.y) * 0.5) / 1.25))"
_quantiles = lambda h, n: ", ".join(
    [f"count({h}) as {n}_n, min({h}) as {n}_min, max({h}) as {n}_max, round(avg({h}), 6) as {n}_mean"]
    + [f"round(quantile_cont({h}, {q}), 6) as {n}_{k}" for q, k in ((0.05, "p05"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.95, "p95"))]
)
MADE = f"""with {P}, g as (select row, col, case when (((row * 7 + col) % 9) + 9) % 9 <> 0 then z end as z from (select cast(floor(y / 0.25) as bigint) as row, cast(floor(x / 0.25) as bigint) as col, round(max(z), 6) as z from p group by 1, 2)),
 l0 as (select * from g a where z >= 0.5 and not exists (select 1 from g b where (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4 and b.z > a.z)), {_rounds},
 tops as materialized (select row || ':' || col as id, (col + 0.5) * 0.25::double as x, (row + 0.5) * 0.25::double as y, z as height from ({" union all ".join(f"select * from k{i}" for i in range(ROUNDS))}) where abs((col + 0.5) * 0.25) + abs((row + 0.5) * 0.25) < 3),
 wood as (select * from p where id % 5 = 0), lines as (select * from p where id % 2 = 1 and id % 11 = 0),
 crowns as materialized (select c.id, c.height, (select min(date '2020-01-01' + cast(f.id % 97 as int)) from p f where f.id % 10 = 3 and abs(c.x - f.x) < 0.7 and abs(c.y - f.y) < 0.7) as date,
  (select min(sqrt((c.x - w.x) ** 2 + (c.y - w.y) ** 2)) from wood w) as tree_dist,
  (select min(sqrt((c.x - r.x - {_along}) ** 2 + (c.y - r.y - {_along} * 0.5) ** 2)) from lines r) as row_dist,
  exists (select 1 from p f where f.id % 10 = 1 and abs(c.x - f.x) < 0.2 and abs(c.y - f.y) < 0.2) as on_footprint from tops c),
 trees as materialized (select w.id, (select max(g.z) from g where (g.row - floor(w.y / 0.25)) ** 2 + (g.col - floor(w.x / 0.25)) ** 2 <= 5.76) as height,
  (select min(sqrt((c.x - w.x) ** 2 + (c.y - w.y) ** 2)) from tops c) as candidate_dist from wood w where abs(w.x) + abs(w.y) < 3),
 s as (select id, cast(floor((y + 0.125 * k.range) / 0.25) as bigint) as row, cast(floor((x + 0.25 * k.range) / 0.25) as bigint) as col from p, range(5) k where id % 2 = 1),
 near as (select a.row, a.col, a.z is not null as valid, max(coalesce(b.z, 0)) >= 0.5 as canopy from g a join g b on (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 4 group by a.row, a.col, a.z),
 cover as materialized (select id, (50 + id % 7)::double as length, count(*) as samples, round(avg(coalesce(valid, false)::int), 4) as valid_share, round(avg(canopy::int) filter (where valid), 4) as cover from s left join near using (row, col) group by 1)"""
QUERIES = {"canopy_candidates": candidates, "canopy_tree_heights": trees, "canopy_summary": summary, "canopy_greenest_roads": greenest}
ORACLES = {
    "canopy_candidates": f"{MADE} select id, round(height, 6) as height, date, round(tree_dist, 6) as tree_dist, round(row_dist, 6) as row_dist, tree_dist > 0.3 as unmapped, on_footprint from crowns",
    "canopy_tree_heights": f"{MADE} select id, round(height, 6) as height, round(candidate_dist, 6) as candidate_dist from trees",
    "canopy_summary": f"""{MADE}, c as (select {_quantiles('height', 'crown')}, {_quantiles('case when not on_footprint then height end', 'open')}, count(*) filter (where on_footprint) as on_footprint, count(*) filter (where tree_dist > 0.3) as unmapped,
 count(*) filter (where tree_dist > 0.3 and row_dist > 0.3) as unmapped_by_rows, count(*) filter (where tree_dist > 0.3 and not on_footprint) as unmapped_open, round(avg((tree_dist > 0.3)::int), 6) as unmapped_share, {", ".join(f"count(*) filter (where tree_dist > {d / 10}) as beyond_{d}" for d in op.UNMAPPED_AT)} from crowns),
 t as (select count(*) as trees, count(*) filter (where height >= 0.5) as trees_with_canopy, {_quantiles('height', 'tree')}, {", ".join(f"count(*) filter (where candidate_dist <= {d / 10}) as seen_{d}" for d in op.SEEN_AT)} from trees),
 r as (select count(*) as roads, count(cover) as roads_with_cover, round(avg(cover), 6) as mean_cover, round(sum(length * cover) / sum(length) filter (where cover is not null), 6) as weighted_cover from cover) select * from c, t, r""",
    "canopy_greenest_roads": f"{MADE} select id, length, samples, valid_share, cover from cover where length >= 50 and cover is not null order by cover desc, length desc, id limit 10",
}
