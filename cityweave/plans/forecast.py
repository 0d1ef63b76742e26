"""KPI, plan and window queries on `part`, `supplier` and `orders`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.functions.columns import digest_draw
from cityweave.operators import forecast as op
from cityweave.operators import panel, windows
from cityweave.plans import panel as panel_plan


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    state = F.when(F.col("p_partkey") % 4 == 0, "complete").when(F.col("p_partkey") % 4 == 1, "active").when(F.col("p_partkey") % 4 == 2, "planned").otherwise("unknown")
    return p.select(F.col("p_partkey").alias("object_id"), F.col("p_brand").alias("sector"), state.alias("state"), F.col("p_retailprice").alias("area"), F.col("p_size").cast("double").alias("floors"), (F.col("p_size") * 3.0).alias("height"))


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.kpis(objects(spark, sf_dir), ["sector"])
    return out.select("sector", "objects", "built", "unknown", *(F.round(c, 4).alias(c) for c in ("floor_area", "height_p50", "height_p90", "built_fraction")))


def kpi_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of built objects over 20 draws of two steps from the fitted transition matrix."""
    matrix = panel.transition_matrix(panel_plan.panel(spark, sf_dir).where("interval_years = 1"), panel_plan.LABELS)
    draws = op.rollout(objects(spark, sf_dir).select("object_id", "state"), matrix, panel_plan.LABELS, 2, 20)
    per = draws.groupBy("step", "draw").agg(F.count_if(F.col("state") == "complete").alias("built"))
    return op.bands(per, ["step"], "built")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levers on every brand that ends in 3 at the first step and on every tenth part at the second, against none."""
    matrix = panel.transition_matrix(panel_plan.panel(spark, sf_dir).where("interval_years = 1"), panel_plan.LABELS)
    o = objects(spark, sf_dir)
    first = o.where("sector like '%3'").select("object_id", F.lit(1).alias("step"), F.lit("complete").alias("target_state"), F.lit(1.5).alias("delta"))
    second = o.where("object_id % 10 = 0").select("object_id", F.lit(2).alias("step"), F.lit("active").alias("target_state"), F.lit(-2.0).alias("delta"))
    draws = op.paired_rollout(o, matrix, panel_plan.LABELS, 2, 8, first.unionByName(second), drawn=digest_draw)
    wide = draws.join(o.select("object_id", "sector"), "object_id")
    is_in = lambda label: lambda c: F.count_if(c == label)
    out = op.paired_bands(wide, ["step", "sector"], {"built": is_in("complete"), "active": is_in("active")})
    return out.select("step", "sector", "kpi", *(F.round(c, 6).alias(c) for c in ("p05", "p50", "p95", "usual_p50", "higher")))


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.groupBy((F.col("l_suppkey") % 400).alias("id")).agg(
        F.round(F.avg("l_discount"), 6).alias("cost"), F.round(-F.avg("l_quantity"), 6).alias("volume"), F.round(F.avg("l_tax"), 6).alias("late")
    )


def pareto(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.pareto(plans(spark, sf_dir), "id", ["cost", "volume", "late"])


def backcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plans(spark, sf_dir).select("id", (F.col("late") <= 0.035).alias("feasible"), (F.col("late") - 0.035).alias("shortfall"), F.col("cost").alias("intensity"))
    return op.backcast(p, 5).select("id", "feasible")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest customers by orders of every nation, with names."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), "c_nationkey")
    return windows.best_per(j.select("n_name", "c_custkey", "total"), ["n_name"], [F.desc("total"), F.asc("c_custkey")], 3)


def rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    low = windows.rank_quantile(o, ["o_orderpriority"], "o_totalprice", 0.5).withColumnRenamed("value", "p50_lower")
    return low.join(windows.rank_quantile(o, ["o_orderpriority"], "o_totalprice", 0.9, upper=True).withColumnRenamed("value", "p90_upper"), "o_orderpriority")


def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).alias("size"))
    return windows.admit_whole(o, "o_custkey", "o_orderkey", "size", 500)


def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every error event its user's last purchase value before it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("last_value"))
    return windows.as_of(left, right, ["user_id"], "ts", "last_value").select("event_id", "last_value")


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return windows.shares(n, ["p_brand"], "n").select("p_brand", "p_type", "n", F.round("share", 9).alias("share"), F.round("running_share", 9).alias("running_share"))


OBJ = "o as (select p_brand as sector, case p_partkey % 4 when 0 then 'complete' when 1 then 'active' when 2 then 'planned' else 'unknown' end as state, p_retailprice as area, cast(p_size as double) as floors, p_size * 3.0 as height from part)"
PLANS = "p as (select l_suppkey % 400 as id, round(avg(l_discount), 6) as cost, round(-avg(l_quantity), 6) as volume, round(avg(l_tax), 6) as late from lineitem group by 1)"
_ORD = "list_position([" + ", ".join(f"'{x}'" for x in panel_plan.LABELS) + "]"


def _stepped(i: int, before: str) -> str:
    """Tables of one step: chances of the states before it, pushed by the step's levers, and the states drawn after it."""
    push = ("case when s.sector like '%3' then exp(1.5) end", "complete") if i == 1 else ("case when s.object_id % 10 = 0 then exp(-2.0) end", "active")
    one = lambda c, by: f"""p{i}{c} as (select s.object_id, s.draw, {_ORD}, target_state) as ord, {by} as w from {before} s join m1 on current_state = s.{c}),
 n{i}{c} as (select object_id, draw, ord, w / sum(w) over (partition by object_id, draw) as p from p{i}{c}),
 c{i}{c} as (select *, sum(p) over (partition by object_id, draw order by ord) as run from n{i}{c}),
 k{i}{c} as (select object_id, draw, coalesce(min(ord) filter (run > u), max(ord)) as ord from c{i}{c} join u{i} using (object_id, draw) group by 1, 2)"""  # noqa: E731
    lever = f"case when {push[0]} is null then m1.p else greatest(m1.p, 1e-12) * case when target_state = '{push[1]}' then {push[0]} else 1 end end"
    at = "[" + ", ".join(f"'{x}'" for x in panel_plan.LABELS) + "]"
    return f"""u{i} as (select object_id, draw, ('0x' || substr(sha256('7:{i}:' || draw || ':' || object_id), 1, 8))::bigint / 4294967296.0::double as u from {before}),
 {one('state', lever)}, {one('usual', 'm1.p')},
 s{i} as (select object_id, draw, b.sector, {at}[x.ord] as state, {at}[y.ord] as usual from k{i}state x join k{i}usual y using (object_id, draw) join {before} b using (object_id, draw))"""


QUERIES = {
    "kpi_by_sector": kpis, "kpi_bands_over_draws": kpi_bands, "scenario_paired_bands": paired, "plan_pareto": pareto, "plan_backcast": backcast, "window_best_per": ranked,
    "window_rank_quantile": rank_quantiles, "window_admit_whole": admitted, "join_as_of": as_of, "window_shares": shares,
}
ORACLES = {
    "kpi_by_sector": f"""with {OBJ} select sector, count(*) as objects, count(*) filter (state = 'complete') as built, count(*) filter (state = 'unknown') as unknown, round(coalesce(sum(area * floors) filter (state = 'complete'), 0), 4) as floor_area,
 round(coalesce(quantile_cont(cast(height as double), 0.5) filter (state = 'complete'), 0), 4) as height_p50, round(coalesce(quantile_cont(cast(height as double), 0.9) filter (state = 'complete'), 0), 4) as height_p90, round(coalesce(sum(area) filter (state = 'complete') / sum(area), 0), 4) as built_fraction from o group by 1""",
    "scenario_paired_bands": f"""with {panel_plan.PANEL}, {panel_plan.MATRIX.format(p='p')}, m1 as (select current_state, target_state, p from m where interval_years = 1), {OBJ.replace('select p_brand', 'select p_partkey as object_id, p_brand')},
 s0 as (select object_id, d.range as draw, sector, state, state as usual from o, range(8) d), {_stepped(1, 's0')}, {_stepped(2, 's1')},
 v as (select 1 as step, sector, draw, state, usual from s1 union all select 2, sector, draw, state, usual from s2),
 t as (select step, sector, draw, 'built' as kpi, count(*) filter (usual = 'complete') as u, count(*) filter (state = 'complete') - count(*) filter (usual = 'complete') as d from v group by 1, 2, 3
  union all select step, sector, draw, 'active', count(*) filter (usual = 'active'), count(*) filter (state = 'active') - count(*) filter (usual = 'active') from v group by 1, 2, 3)
 select step, sector, kpi, round(quantile_cont(d::double, 0.05), 6) as p05, round(quantile_cont(d::double, 0.5), 6) as p50, round(quantile_cont(d::double, 0.95), 6) as p95, round(quantile_cont(u::double, 0.5), 6) as usual_p50, round(avg((d > 0)::int), 6) as higher
 from t group by 1, 2, 3""",
    "plan_pareto": f"with {PLANS} select * from p where not exists (select 1 from p q where q.cost <= p.cost and q.volume <= p.volume and q.late <= p.late and (q.cost < p.cost or q.volume < p.volume or q.late < p.late))",
    "plan_backcast": f"with {PLANS} select id, late <= 0.035 as feasible from p order by late <= 0.035 desc, case when late > 0.035 then late - 0.035 end nulls first, cost, id limit 5",
    "window_best_per": "with o as (select o_custkey, round(sum(o_totalprice), 2) as total from orders group by 1), r as (select n_name, c_custkey, total, cast(row_number() over (partition by n_name order by total desc, c_custkey) as int) as rank from o join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey) select * from r where rank <= 3",
    "window_rank_quantile": "with r as (select o_orderpriority, o_totalprice, row_number() over (partition by o_orderpriority order by o_totalprice) as r, count(*) over (partition by o_orderpriority) as n from orders) select o_orderpriority, max(o_totalprice) filter (r = floor(0.5 * (n - 1)) + 1) as p50_lower, max(o_totalprice) filter (r = ceil(0.9 * (n - 1)) + 1) as p90_upper from r group by 1",
    "join_as_of": "select e.event_id, p.value as last_value from (select * from events where event_type = 'error') e asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts >= p.ts",
    "window_shares": "with n as (select p_brand, p_type, count(*) as n from part group by 1, 2) select p_brand, p_type, n, round(n / sum(n) over (partition by p_brand), 9) as share, round(sum(n) over (partition by p_brand order by n desc, p_type rows unbounded preceding) / sum(n) over (partition by p_brand), 9) as running_share from n",
}
