"""Panel queries on `events`: object = user_id, waves are ten-day blocks, state = the last event type of a block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.operators import panel as op

LABELS = ["active", "complete", "planned", "stalled", "unknown"]
#: Raw event types to states of the panel.
STATES = {"view": "planned", "click": "active", "purchase": "complete", "error": "stalled"}


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    wave = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int")
    last = ev.groupBy(F.col("user_id").alias("object_id"), wave.alias("wave")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("raw"))
    mapping = spark.createDataFrame(list(STATES.items()), "raw string, state string")
    return op.crosswalk(last, mapping, "raw", "state")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = waves(spark, sf_dir)
    a = w.select("object_id", F.col("wave").alias("start_year"), F.col("state").alias("current_state"), F.col("raw").alias("raw_current"))
    b = w.select("object_id", F.col("wave").alias("target_year"), F.col("state").alias("target_state"), F.col("raw").alias("raw_target"))
    return a.join(b, "object_id").where("target_year > start_year").withColumn("interval_years", F.col("target_year") - F.col("start_year"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.transition_counts(panel(spark, sf_dir)).withColumn("share", F.round("share", 9))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.interval_summary(panel(spark, sf_dir), "raw_current", "raw_target")
    return out.withColumns({c: F.round(c, 9) for c in ("change_rate", "raw_change_rate")})


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.transition_matrix(panel(spark, sf_dir), LABELS).withColumn("p", F.round("p", 9))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on wave 0 to 1, score on wave 1 to 2: persistence and the transition matrix."""
    p = panel(spark, sf_dir)
    past, future = op.select_interval(p, 0, 1), op.select_interval(p, 1, 2)
    names = ("accuracy", "macro_f1", "brier", "log_loss")
    score = lambda n, s: op.classification_metrics(s, LABELS).select(F.lit(n).alias("model"), "n", *(F.round(c, 6).alias(c) for c in names))
    return score("persistence", op.one_hot(future)).unionAll(score("markov", op.predict(future, op.transition_matrix(past, LABELS))))


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years since a customer's first order, visible at the start of 1997 and 1999 only where it lies before."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    first = orders.groupBy(F.col("o_custkey").alias("object_id")).agg(F.min(F.year("o_orderdate")).alias("first_year"))
    rows = first.withColumn("start_year", F.explode(F.array(F.lit(1996), F.lit(1999))))
    out = op.point_in_time(rows, "first_year", "start_year", "since_first")
    return out.select("object_id", "start_year", "since_first", "since_first_known")


PANEL = """w as (select object_id, wave, raw, coalesce(case raw when 'view' then 'planned' when 'click' then 'active' when 'purchase' then 'complete' when 'error' then 'stalled' end, 'unknown') as state
 from (select user_id as object_id, cast(least(floor((day(ts) - 1) / 10), 2) as int) as wave, arg_max(event_type, (ts, event_id)) as raw from events group by all)),
p as (select a.object_id, a.wave as start_year, b.wave as target_year, a.state as current_state, b.state as target_state, a.raw as raw_current, b.raw as raw_target, b.wave - a.wave as interval_years
 from w a join w b using (object_id) where b.wave > a.wave)"""
LIST = ", ".join(f"('{x}')" for x in LABELS)
MATRIX = f"""l(x) as (values {LIST}), g as (select i.interval_years, a.x as current_state, b.x as target_state, coalesce(n, 0) + 0.5 as v
 from (select distinct interval_years from {{p}}) i, l a cross join l b left join (select interval_years, current_state, target_state, count(*) as n from {{p}} group by all) c
 on c.interval_years = i.interval_years and c.current_state = a.x and c.target_state = b.x), m as (select interval_years, current_state, target_state, v / sum(v) over (partition by interval_years, current_state) as p from g)"""
QUERIES = {"panel_transition_counts": counts, "panel_interval_summary": summary, "panel_transition_matrix": matrix, "panel_benchmark": benchmark, "panel_as_of_covariates": as_of}
ORACLES = {
    "panel_transition_counts": f"with {PANEL} select current_state, target_state, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from p group by 1, 2",
    "panel_interval_summary": f"with {PANEL} select start_year, target_year, count(*) as rows, count(distinct object_id) as objects, cast(sum(cast(current_state <> target_state as int)) as bigint) as changed, round(avg(cast(current_state <> target_state as int)), 9) as change_rate, round(avg(cast(raw_current <> raw_target as int)), 9) as raw_change_rate from p group by 1, 2",
    "panel_transition_matrix": f"with {PANEL}, {MATRIX.format(p='p')} select interval_years, current_state, target_state, round(p, 9) as p from m",
    "panel_benchmark": f"""with {PANEL}, past as (select * from p where start_year = 0 and target_year = 1), fut as (select row_number() over () as id, * from p where start_year = 1 and target_year = 2), {MATRIX.format(p='past')},
 s as (select 'persistence' as model, id, fut.target_state as t, l.x, cast(l.x = fut.current_state as double) as q from fut, l union all
       select 'markov', id, fut.target_state, m.target_state, m.p from fut join m on m.current_state = fut.current_state),
 b as (select model, id, t, arg_max(x, (q, -ord)) as best from (select s.*, list_position([{', '.join(f"'{x}'" for x in LABELS)}], x) as ord from s) group by all),
 e as (select model, id, sum((q - cast(x = t as int)) ** 2) as brier, sum(case when x = t then -ln(greatest(q, 1e-12)) end) as loss from s group by all),
 f as (select model, x, 2 * count(*) filter (best = x and t = x) as tp2, count(*) filter (best = x) + count(*) filter (t = x) as seen from b, l group by all)
 select b.model, count(*) as n, round(avg(cast(best = t as int)), 6) as accuracy, any_value(round(f1, 6)) as macro_f1, round(avg(brier), 6) as brier, round(avg(loss), 6) as log_loss
 from b join e using (model, id) join (select model, avg(case when seen > 0 then tp2 / seen else 0 end) as f1 from f group by 1) using (model) group by 1""",
    "panel_as_of_covariates": "select o.object_id, y as start_year, case when f <= y then y - f end as since_first, cast(f <= y as int) as since_first_known from (select o_custkey as object_id, cast(min(year(o_orderdate)) as int) as f from orders group by 1) o, (values (1996), (1999)) t(y)",
}
