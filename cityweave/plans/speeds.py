"""Speed queries on `events`: road = user_id % roads, class = event_type, speed = value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.operators import speeds as op


def readings(spark: SparkSession, sf_dir: str, roads: int = 20) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    ev = ev.select((F.col("user_id") % roads).alias("road"), F.concat(F.lit("c"), F.col("user_id") % roads % 5).alias("cls"), F.col("value").alias("speed"), "ts")
    return op.split_by_day(op.calendar(ev), (1, 20), (21, 31))


def holdout_scores(spark: SparkSession, sf_dir: str, roads: int = 20, min_count: int = 5) -> DataFrame:
    return op.error_metrics(op.predictions(readings(spark, sf_dir, roads), min_count), ["baseline"])


def band_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return op.readings_in_band(r, op.predictions(r, 5)).withColumn("share", F.round("share", 6))


def common_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.error_metrics(op.common_cells(op.predictions(readings(spark, sf_dir), 5)), ["baseline"])


def fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.fit(readings(spark, sf_dir).where("split = 'calibration'"), op.BASELINES["road_day_hour"])
    return out.select("road", "weekend", "hour", "n", *(F.round(c, 6).alias(c) for c in ("p10", "median", "p90")))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.hourly_profile(readings(spark, sf_dir)).select("road", "hour", F.round("kmh", 6).alias("kmh"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = readings(spark, sf_dir)
    return r.groupBy("split").agg(
        F.count("*").alias("readings"), F.countDistinct("day").alias("days"), F.min("day").cast("string").alias("first_day"),
        F.max("day").cast("string").alias("last_day"), F.count_if(F.col("speed") == 0).alias("zeros"), F.count_if(F.col("speed") > 160).alias("fast"),
        F.countDistinct("road").alias("roads"),
    )


def rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    raw = ev.select(
        F.when(F.col("event_id") % 97 == 0, "x").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
        F.when(F.col("event_id") % 89 == 0, "25:00:00").otherwise(F.date_format("ts", "HH:mm:ss")).alias("time"),
        F.when(F.col("event_id") % 83 == 0, "fast").when(F.col("event_id") % 79 == 0, "-1").otherwise(F.col("value").cast("string")).alias("velocity"),
        F.concat(F.when(F.col("event_id") % 73 == 0, "node/").otherwise("way/"), F.col("user_id")).alias("way"),
    )
    return op.validated(raw, 200).groupBy(F.coalesce("rejected", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed edges 0, 20, ..., 200; the last bin is closed on both sides, the rest above is its own."""
    v = F.col("speed")
    bin_ = F.when(v > 200, 10).otherwise(F.least(F.floor(v / 20), F.lit(9))).cast("int")
    return readings(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


READINGS = """r as (
  select user_id % 20 as road, 'c' || cast(user_id % 20 % 5 as varchar) as cls, value as speed, ts, hour(ts) as hour,
    case when isodow(ts) >= 6 then 1 else 0 end as weekend, cast(ts as date) as day,
    case when day(ts) between 1 and 20 then 'calibration' when day(ts) between 21 and 31 then 'holdout' else 'other' end as split
  from events)"""


def _scored() -> str:
    parts = []
    for name, keys in op.BASELINES.items():
        k = ", ".join(keys)
        parts.append(
            f"select cells.*, '{name}' as baseline, f.pred, f.p10, f.p90 from cells left join (select {k}, quantile_cont(speed, 0.1) as p10, "
            f"quantile_cont(speed, 0.5) as pred, quantile_cont(speed, 0.9) as p90 from r where split = 'calibration' group by {k} having count(*) >= 5) f using ({k})"
        )
    return f"""{READINGS}, cells as (select road, cls, weekend, hour, count(*) as n, quantile_cont(speed, 0.5) as observed from r
  where split = 'holdout' group by all having count(*) >= 5), s as ({" union all ".join(f"select road, weekend, hour, n, observed, baseline, pred, p10, p90 from ({p})" for p in parts)})"""


METRICS = """select baseline, count(*) as cells, count(pred) as supported, round(avg(abs(pred - observed)), 6) as mae,
 round(quantile_cont(abs(pred - observed), 0.5), 6) as median_abs, round(avg(pred - observed), 6) as bias,
 round(sum(abs(pred - observed) * n) / sum(case when pred is not null then n end), 6) as weighted_mae,
 round(avg(case when pred is not null then cast(observed between p10 and p90 as int) end), 6) as band_share,
 round(avg(case when pred is not null then cast(abs(pred - observed) <= 0.25 * observed as int) end), 6) as tolerance_share"""
QUERIES = {
    "speed_holdout_scores": holdout_scores, "speed_common_cell_scores": common_scores, "speed_baseline_fit": fitted, "speed_readings_in_band": band_readings,
    "speed_hourly_profile": profile, "speed_audit": audit, "speed_rejections": rejections, "speed_histogram": histogram,
}
ORACLES = {
    "speed_holdout_scores": f"with {_scored()} {METRICS} from s group by baseline",
    "speed_common_cell_scores": f"with {_scored()}, t as (select *, min(cast(pred is not null as int)) over (partition by road, weekend, hour) as whole from s) {METRICS} from t where whole = 1 group by baseline",
    "speed_readings_in_band": f"with {_scored()} select baseline, count(*) as readings, count(*) filter (where speed between p10 and p90) as inside, round(count(*) filter (where speed between p10 and p90) / count(*)::double, 6) as share from s join r using (road, weekend, hour) where split = 'holdout' and pred is not null group by 1",
    "speed_baseline_fit": f"with {READINGS} select road, weekend, hour, count(*) as n, round(quantile_cont(speed, 0.1), 6) as p10, round(quantile_cont(speed, 0.5), 6) as median, round(quantile_cont(speed, 0.9), 6) as p90 from r where split = 'calibration' group by road, weekend, hour",
    "speed_hourly_profile": f"""with {READINGS},
 roads as (select road, cls, quantile_cont(speed, 0.5) as overall from r group by all),
 own as (select road, hour, quantile_cont(speed, 0.5) as own from r group by all having count(*) >= 10),
 ch as (select cls, hour, quantile_cont(speed, 0.5) as ch from r group by all), c as (select cls, quantile_cont(speed, 0.5) as c from r group by all),
 g as (select roads.*, cast(h.range as int) as hour from roads, range(24) h)
 select road, hour, round(least(greatest(coalesce(own, ch * overall / c, c), 3), 160), 6) as kmh
 from g left join own using (road, hour) left join ch using (cls, hour) left join c using (cls)""",
    "speed_audit": f"with {READINGS} select split, count(*) as readings, count(distinct day) as days, cast(min(day) as varchar) as first_day, cast(max(day) as varchar) as last_day, count(*) filter (speed = 0) as zeros, count(*) filter (speed > 160) as fast, count(distinct road) as roads from r group by split",
    "speed_rejections": """select case when event_id % 97 = 0 then 'bad_date' when event_id % 89 = 0 then 'bad_time' when event_id % 83 = 0 then 'bad_velocity'
 when event_id % 79 = 0 then 'negative_velocity' when value > 200 then 'over_cap' when event_id % 73 = 0 then 'bad_way' else 'valid' end as outcome, count(*) as n from events group by 1""",
    "speed_histogram": "select cast(case when value > 200 then 10 else least(floor(value / 20), 9) end as int) as bin, count(*) as n from events group by 1",
}
