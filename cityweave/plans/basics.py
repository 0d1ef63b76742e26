"""Queries of identities, distributions, searches and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.functions import columns as fn
from cityweave.operators import audit, basics, evidence, matching, panel, stats, windows
from cityweave.plans import panel as panel_plan


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").withColumn("given", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" k"), "p_partkey")).when(F.col("p_partkey") % 3 == 1, " "))
    return basics.resolved_ids(p, "given", ["p_brand", "p_partkey"]).select("p_partkey", "object_id")


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderstatus")).alias("s2"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(" P ")).otherwise("").alias("s1"))
    return basics.latest_status(o, ["s2", "s1"]).groupBy("status", "wave").agg(F.count("*").alias("n"))


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = basics.distribution(_t(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return out.select("o_orderpriority", "n", *(F.round(c, 4).alias(c) for c in out.columns if c not in ("o_orderpriority", "n")))


def tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basics.top_and_other(_t(spark, sf_dir, "part"), "p_brand", "p_type", 2)


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_type", F.hour("ts").alias("hour"))
    out = basics.class_hours(e, "event_type", "hour")
    return out.select("event_type", *(F.col(str(h)).cast("long").alias(f"h{h:02d}") for h in range(24)))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basics.transitions_between(_t(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in text: every fifth is negative, every seventh no number."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(F.col("o_orderkey") % 5 == 0, "-3").otherwise(F.col("o_totalprice").cast("string")).alias("v"))
    return o.groupBy((F.col("o_orderkey") % 10).alias("k")).agg(F.count(fn.number("v")).alias("n"), F.round(F.sum(fn.number("v")), 2).alias("total"))


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_brand").alias("names"))
    return matching.ranked_names(p, "Brand#1", 12).select("id")


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = windows.batches(_t(spark, sf_dir, "customer"), ["c_mktsegment"], ["c_custkey"], 50)
    return c.groupBy("c_mktsegment", "pass").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first_key"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select((F.col("p_size") / 10).alias("x"), (F.col("p_partkey") % 13 / 10).alias("w"), (F.col("p_retailprice") / 1000).alias("z"))
    out = windows.normal_equations(p, ["x", "w"], "z")
    return out.select("n", *(F.round(c, 5).alias(c) for c in out.columns if c != "n"))


#: Tables with the columns that a row's digest covers, in order of names.
DIGESTED = {
    "nation": ("n_name", "n_nationkey", "n_regionkey"), "region": ("r_name", "r_regionkey"), "supplier": ("s_acctbal", "s_name", "s_nationkey", "s_suppkey"),
    "customer": ("c_acctbal", "c_custkey", "c_mktsegment", "c_name", "c_nationkey"),
}


def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and order-free digest of four tables, each dealt anew before."""
    made = [audit.table_digest(_t(spark, sf_dir, name).repartition(5)).select(F.lit(name).alias("name"), "rows", "digest") for name in DIGESTED]
    return made[0].unionAll(made[1]).unionAll(made[2]).unionAll(made[3])


def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", fn.angle_delta(F.col("value"), F.col("user_id") * 7 % 360).alias("d"))
    return e.select("event_id", F.round("d", 6).alias("delta"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as citations of their customer's account, in force for two years from a date by key; every 20th replaced."""
    c = _t(spark, sf_dir, "customer")
    start = F.date_add(F.lit("1995-06-01").cast("date"), (F.col("c_custkey") % 700).cast("int"))
    src = c.select(
        F.col("c_custkey").cast("string").alias("id"), start.alias("effective_from"), F.date_add(start, 730).alias("effective_until"),
        F.when(F.col("c_custkey") % 20 == 1, F.array((F.col("c_custkey") - 1).cast("string"))).otherwise(F.array().cast("array<string>")).alias("supersedes"), (F.col("c_acctbal") > 0).alias("verified"),
    )
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("source_id"), F.to_date("o_orderdate").alias("on"))
    out = evidence.citation_problems(o, src)
    return out.select(F.explode("problems").alias("problem")).select(F.regexp_replace("problem", " by .*", "").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temperature of the transition matrix's forecasts on the last interval, from those of the first."""
    p = panel_plan.panel(spark, sf_dir)
    m = panel.transition_matrix(panel.select_interval(p, 0, 1), panel_plan.LABELS)
    s = panel.predict(panel.select_interval(p, 1, 2), m)
    order = F.array(*map(F.lit, panel_plan.LABELS))
    rows = s.select(F.transform(order, lambda x: F.element_at("p", x)).alias("p"), (F.array_position(order, F.col("target_state")) - 1).cast("int").alias("target"))
    t = stats.temperature(rows)
    return rows.agg(F.count("*").alias("n"), F.lit(t).alias("temperature"))


QUERIES = {
    "ids_resolved": ids, "status_latest": status, "distribution_summary": spread, "top_and_other": tops, "pivot_class_hours": hours, "sequence_transitions": moves, "numbers_coerced": coerced,
    "place_search": search, "window_batches": passes, "stats_normal_equations": plane, "digest_order_free": digests, "angle_delta": angles, "evidence_citations": citations, "temperature_calibration": calibrated,
}
ORACLES = {
    "ids_resolved": "select p_partkey, case when p_partkey % 3 = 0 then 'k' || p_partkey else p_brand || ':' || p_partkey end as object_id from part",
    "status_latest": "select case when o_orderkey % 4 = 0 then o_orderstatus when o_orderkey % 3 = 0 then 'P' else 'unknown' end as status, case when o_orderkey % 4 = 0 then 's2' when o_orderkey % 3 = 0 then 's1' end as wave, count(*) as n from orders group by 1, 2",
    "distribution_summary": "select o_orderpriority, count(o_totalprice) as n, round(min(o_totalprice), 4) as least, round(quantile_cont(o_totalprice, 0.05), 4) as p05, round(quantile_cont(o_totalprice, 0.25), 4) as p25, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.75), 4) as p75, round(quantile_cont(o_totalprice, 0.95), 4) as p95, round(avg(o_totalprice), 4) as mean, round(max(o_totalprice), 4) as largest from orders group by 1",
    "top_and_other": "with n as (select p_brand, p_type, count(*) as n from part group by 1, 2), r as (select *, row_number() over (partition by p_brand order by n desc, p_type) as r from n) select p_brand, case when r <= 2 then p_type else 'other' end as p_type, cast(sum(n) as bigint) as n from r group by 1, 2",
    "pivot_class_hours": "select event_type, " + ", ".join(f"count(*) filter (hour(ts) = {h}) as h{h:02d}" for h in range(24)) + " from events group by 1",
    "sequence_transitions": 'with l as (select lag(event_type) over (partition by user_id order by ts, event_id) as "from", event_type as "to" from events) select "from", "to", count(*) as n from l where "from" is not null group by 1, 2',
    "numbers_coerced": "select o_orderkey % 10 as k, count(v) as n, round(sum(v), 2) as total from (select o_orderkey, case when o_orderkey % 7 = 0 or o_orderkey % 5 = 0 then null else o_totalprice end as v from orders) group by 1",
    "place_search": "select p_partkey as id from part where p_brand like 'Brand#1%' order by case when lower(p_brand) = 'brand#1' then 0 else 1 end, length(p_brand), p_partkey limit 12",
    "window_batches": "with b as (select c_mktsegment, c_custkey, cast(floor((row_number() over (partition by c_mktsegment order by c_custkey) - 1) / 50) as bigint) as pass from customer) select c_mktsegment, pass, count(*) as n, min(c_custkey) as first_key from b group by 1, 2",
    "stats_normal_equations": "with p as (select p_size / 10 as x, p_partkey % 13 / 10 as w, p_retailprice / 1000 as z from part) select count(*) as n, round(sum(x), 5) as s_x, round(sum(w), 5) as s_w, round(sum(z), 5) as s_z, round(sum(x * x), 5) as s_x_x, round(sum(x * w), 5) as s_x_w, round(sum(x * z), 5) as s_x_z, round(sum(w * w), 5) as s_w_w, round(sum(w * z), 5) as s_w_z, round(sum(z * z), 5) as s_z_z from p",
    "digest_order_free": " union all ".join(
        f"""select '{t}' as name, rows, sha256(concat_ws(':', rows, {', '.join(f'w{i}' for i in range(8))})) as digest from (select count(*) as rows,
 {', '.join(f"sum(cast('0x' || d[{8 * i + 1}:{8 * i + 8}] as bigint)) as w{i}" for i in range(8))} from (select sha256(to_json({{{', '.join(f"'{c}': {c}" for c in columns)}}})) as d from {t}))"""
        for t, columns in DIGESTED.items()
    ),
    "angle_delta": "with d as (select event_id, fmod(fmod(value - user_id * 7 % 360, 360) + 360, 360) as d from events) select event_id, round(case when d > 180 then d - 360 else d end, 6) as delta from d",
    "evidence_citations": """with s as (select c_custkey as id, date '1995-06-01' + cast(c_custkey % 700 as int) as f, date '1995-06-01' + cast(c_custkey % 700 as int) + 730 as u, c_acctbal > 0 as verified, c_custkey % 20 = 0 and c_custkey + 1 in (select c_custkey from customer) as replaced from customer),
 j as (select cast(o_orderdate as date) as d, s.* from orders left join s on o_custkey = id), p as (select unnest([case when id is null then 'unknown source' end, case when d < f then 'not yet in force' end, case when d > u then 'expired' end, case when replaced then 'superseded' end, case when not verified then 'not verified' end]) as problem from j) select problem, count(*) as n from p where problem is not null group by 1""",
}
