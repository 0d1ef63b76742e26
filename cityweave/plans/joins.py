"""Queries of guarded and ranked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.operators import joins as op
from cityweave.plans.more import P
from cityweave.plans.spatial import points

WEIGHTS = {"a": 1.0, "b": 0.5, "c": 0.25}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_acctbal")
    return op.attach_unique(p, s, "id")


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumnRenamed("user_id", "way")
    w = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("way"), F.col("s_nationkey").alias("cls"))
    return op.on_network(e, w).groupBy("cls").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.completeness(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels").select("doc_id").unionAll(_t(spark, sf_dir, "benchmark").select("item_id")), "doc_id")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of users."""
    e = _t(spark, sf_dir, "events")
    return op.distinct_frames(e.select("user_id", "event_id", "value"), "user_id", "event_id").withColumnRenamed("event_id", "first_event")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    kinds = p.where("id % 2 = 1").select("id", "x", "y", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("id") % 3 + 1).cast("int")).alias("kind"))
    return op.weighted_around(p.where("id % 2 = 0"), kinds, WEIGHTS, 0.5)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).where("id % 2 = 1")
    return p.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 0.4).alias("x2"), (F.col("y") + 0.2).alias("y2"))


def around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.roads_around(points(spark, sf_dir).where("id % 2 = 0"), lines(spark, sf_dir), 0.6, 12).withColumn("dist", F.round("dist", 6))


def cropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.cropped(points(spark, sf_dir).where("id % 2 = 0"), lines(spark, sf_dir).where("x1 < 0.5"), 0.2).select("id")


QUERIES = {
    "join_unique": attached, "join_on_network": network, "audit_completeness": complete, "union_distinct_frames": frames, "spatial_weighted_around": features, "spatial_roads_around": around,
    "spatial_cropped": cropped,
}
ORACLES = {
    "join_unique": "select p_partkey as id, p_size, s_acctbal from part left join supplier on s_suppkey = p_partkey",
    "join_on_network": "select s_nationkey as cls, count(*) as n, round(avg(value), 6) as mean from events join supplier on s_suppkey = user_id group by 1",
    "audit_completeness": "with h as (select doc_id, count(*) as n from (select doc_id from labels union all select item_id from benchmark) group by 1), j as (select d.doc_id as d, h.doc_id as h, h.n from (select distinct doc_id from documents) d full join h using (doc_id)) select count(*) filter (where h is null) as missing, count(*) filter (where d is null) as unknown, count(*) filter (where n > 1) as repeated from j",
    "union_distinct_frames": "select user_id, min(event_id) as first_event, arg_min(value, event_id) as value from events group by 1",
    "spatial_weighted_around": f"with {P}, n as (select a.id, b.id % 3 as k from p a join p b on a.id % 2 = 0 and b.id % 2 = 1 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.5) select id, count(*) filter (where k = 0) as a, count(*) filter (where k = 1) as b, count(*) filter (where k = 2) as c, count(*) filter (where k = 0) * 1.0::double + count(*) filter (where k = 1) * 0.5::double + count(*) filter (where k = 2) * 0.25::double as score from n group by 1",
    "spatial_roads_around": f"with {P}, n as (select a.id, b.id as segment, sqrt((a.x - (b.x + b.x + 0.4) / 2) ** 2 + (a.y - (b.y + b.y + 0.2) / 2) ** 2) as dist from p a join p b on a.id % 2 = 0 and b.id % 2 = 1), r as (select *, row_number() over (partition by id order by dist, segment) as rank from n where dist <= 0.6) select id, segment, round(dist, 6) as dist, cast(rank as int) as rank from r where rank <= 12",
    "spatial_cropped": f"with {P}, s as (select x as x1, y as y1 from p where id % 2 = 1 and x < 0.5), q as (select p.id, p.x, p.y, s.*, least(1.0, greatest(0.0, ((p.x - x1) * 0.4 + (p.y - y1) * 0.2) / 0.2)) as t from p, s where p.id % 2 = 0) select distinct id from q where sqrt((x - x1 - t * 0.4) ** 2 + (y - y1 - t * 0.2) ** 2) <= 0.2",
}
