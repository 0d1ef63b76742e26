"""Ledger queries on `events`: run = user_id % 2, road = user_id % 50, rate = value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.operators import ledger as op


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select((F.col("user_id") % 2).cast("int").alias("run"), (F.col("user_id") % 50).alias("road"), F.col("user_id").alias("vehicle"), "ts", F.col("value").alias("rate"), (F.col("value") % 90).alias("level"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.exhaust(samples(spark, sf_dir), ["run", "road"]).select("run", "road", F.round("mass", 3).alias("mass"), F.round("seconds", 3).alias("seconds"))


def saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = op.exhaust(samples(spark, sf_dir).withColumn("block", F.floor(F.col("road") / 10)), ["run", "block"])
    return op.saved(t, ["block"]).select("block", *(F.round(c, 3).alias(c) for c in ("baseline", "plan", "saved", "percent")))


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.equivalent_level(samples(spark, sf_dir), ["run", "road"], "level").withColumn("leq", F.round("leq", 4))


def delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select(F.when(F.col("rate") > 60, 1).otherwise(0).alias("run"), "vehicle", F.col("rate").alias("seconds"))
    return op.paired_delay(s).withColumn("mean_delay", F.round("mean_delay", 6))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).select(F.dayofmonth("ts").alias("frame"), "vehicle", "rate").groupBy("frame", "vehicle").agg(F.max("rate").alias("x"))
    return op.trajectory_steps(s).withColumn("largest", F.round("largest", 6))


S = """s as (select cast(user_id % 2 as int) as run, user_id % 50 as road, user_id as vehicle, ts, value as rate, fmod(value, 90) as level from events),
 t as (select run, ts, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by run order by ts) as dt from (select distinct run, ts from s)), d as (select * from s join t using (run, ts) where dt > 0)"""
QUERIES = {"ledger_exhaust": totals, "ledger_saved": saved, "ledger_noise": noise, "ledger_paired_delay": delays, "trajectory_steps": steps}
ORACLES = {
    "ledger_exhaust": f"with {S} select run, road, round(sum(rate * dt / 1000), 3) as mass, round(sum(dt), 3) as seconds from d group by 1, 2",
    "ledger_saved": f"with {S}, m as (select run, cast(floor(road / 10) as bigint) as block, sum(rate * dt / 1000) as mass from d group by 1, 2), p as (select block, coalesce(sum(mass) filter (run = 0), 0) as b, coalesce(sum(mass) filter (run = 1), 0) as p from m group by 1) select block, round(b, 3) as baseline, round(p, 3) as plan, round(b - p, 3) as saved, round(case when b > 0 then 100 * (b - p) / b end, 3) as percent from p",
    "ledger_noise": f"with {S} select run, road, round(10 * log10(sum(pow(10, level / 10) * dt) / sum(dt) + 1e4), 4) as leq from d group by 1, 2",
    "ledger_paired_delay": "with v as (select user_id, min(value) filter (value <= 60) as a, min(value) filter (value > 60) as b from events group by 1) select count(*) filter (a is not null and b is not null) as paired, count(*) filter (a is not null and b is null) as overdue, round(avg(b - a), 6) as mean_delay from v",
    "trajectory_steps": """with s as (select day(ts) as frame, user_id as vehicle, max(value) as x from events group by 1, 2), f as (select frame, dense_rank() over (order by frame) as i from (select distinct frame from s)),
 l as (select *, lag(i) over w as pi, lag(x) over w as px from s join f using (frame) window w as (partition by vehicle order by i))
 select count(*) as samples, count(distinct vehicle) as vehicles, count(*) filter (pi = i - 1) as pairs, count(*) filter (pi = i - 1 and abs(x - px) > 0) as moving, round(max(case when pi = i - 1 then abs(x - px) end), 6) as largest from l""",
}
