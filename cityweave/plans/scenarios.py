"""Queries of scenario changes, candidates, lever checks, texts and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.functions import columns as fn
from cityweave.operators import scenarios as op
from cityweave.plans.more import P
from cityweave.plans.spatial import points


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bands(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    e = _t(spark, sf_dir, "events").where(F.col("user_id") % 2 == odd)
    return e.groupBy(F.dayofmonth("ts").alias("year_offset"), F.col("event_type").alias("kpi")).agg(F.median("value").alias("p50"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = op.changes(bands(spark, sf_dir, 1), bands(spark, sf_dir, 0))
    return out.select("year_offset", "kpi", *(F.round(c, 6).alias(c) for c in ("p50", "usual", "median_change")))


def levers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as levers on customers; numbers past the table are unknown objects."""
    s = _t(spark, sf_dir, "supplier")
    lever = s.select(
        (F.col("s_suppkey") % 90).alias("lever"), F.round(F.col("s_acctbal") / 2500, 2).alias("delta"), (F.col("s_suppkey") % 5).alias("step"),
        F.array(F.col("s_suppkey"), F.col("s_suppkey") * 20).alias("object_ids"),
    )
    return op.lever_issues(lever, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("object_id")), 4)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    settings = li.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("candidate"), (F.col("l_discount") - 0.05).alias("delta"), F.col("l_quantity").alias("scope"))
    values = o.select(F.col("o_orderkey").alias("candidate"), F.lit("price").alias("kpi"), F.lit(2).alias("year_offset"), F.col("o_totalprice").alias("value"))
    values = values.unionAll(o.select("o_orderkey", F.lit("late"), F.lit(1), F.dayofmonth("o_orderdate").cast("double")))
    targets = spark.createDataFrame([("price", 2, ">=", 90000.0), ("late", 1, "<=", 20.0)], "kpi string, year_offset int, op string, target double")
    return op.evaluated(settings, values, targets).select("candidate", F.round("intensity", 5).alias("intensity"), "feasible", F.round("least_margin", 4).alias("least_margin"))


def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    rec = F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") - 1000)
    floors = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size"))
    h, kind = op.resolved_height(rec, floors, F.when(F.col("p_partkey") % 5 == 0, 7.5))
    return p.select("p_partkey", F.round(h, 4).alias("height"), kind.alias("kind"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "supplier")
    out = op.without_known(c.select(F.col("c_custkey").alias("id"), F.lit("new").alias("origin")), s.select(F.col("s_suppkey").alias("id"), F.lit("known").alias("origin")), "id")
    return out.groupBy("origin").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    own = p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("height"), F.when(F.col("p_size") < 20, "fallback").otherwise("mapped").alias("kind"))
    return op.companion_heights(own, s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("height")))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    b = p.select("id", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("z")).alias("x2"), (F.col("y") + 0.5).alias("y2"))
    return op.overlapping(b, (-0.5, -0.5, 0.5, 0.5)).select("id")


def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", "x", "y", F.when(F.col("id") % 7 != 0, F.col("z")).alias("x2"), F.when(F.col("id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("x")).alias("y2"))
    return p.groupBy(op.bounds_issue(("x", "y", "x2", "y2")).alias("issue")).agg(F.count("*").alias("n"))


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    pairs = li.select(F.col("l_suppkey").alias("photo"), F.col("l_partkey").alias("building")).distinct()
    dec = pairs.where("building % 11 = 0").select("photo", "building", (F.col("building") % 2 == 0).alias("keep"), F.lit("pair").alias("reason"))
    dec = dec.unionAll(pairs.where("photo % 6 = 0").select("photo", F.lit(None).cast("long"), F.lit(False), F.lit("photo")).distinct())
    return op.reviewed(pairs, dec).groupBy("status", "reason").agg(F.count("*").alias("n"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.gap_counts(_t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), _t(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"))


def focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.nearest_to(points(spark, sf_dir), 0.2, -0.1, 12).select("id", F.round("dist", 6).alias("dist"))


def citywide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with their types as requests."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 3 == 0, "Across the CITY").when(F.col("p_partkey") % 3 == 1, "partout"), "p_type").alias("q"))
    return p.select("p_partkey", fn.asks_citywide("q").alias("citywide"))


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("way/"), "k")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("w"), "k", F.lit("@4"))).otherwise("k")
    o = o.withColumn("raw", raw)
    return o.select("o_orderkey", fn.way_id("raw").alias("way"), F.nullif(fn.osm_id("raw"), F.lit("")).alias("osm"))


def noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").withColumn("d", (F.col("value") - 40) / 10)
    out = e.groupBy(fn.noise_words(F.col("d")).alias("words")).agg(F.count("*").alias("n"), F.round(F.sum(F.pow(F.lit(2.0), F.col("d") / 10)), 3).alias("loudness"))
    return out


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    raw = F.when(F.col("c_custkey") % 4 == 0, " ne ").when(F.col("c_custkey") % 4 == 1, F.col("c_custkey").cast("string")).when(F.col("c_custkey") % 4 == 2, "x").otherwise("W")
    return c.withColumn("raw", raw).select("c_custkey", fn.heading("raw").alias("angle"))


def since(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders").withColumn("y", fn.years_since(F.year("o_orderdate"), F.lit(1998)))
    return o.groupBy("y").agg(F.count("*").alias("n"))


def normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.normalised(F.array("l_discount", "l_tax", F.col("l_discount") * 0), 2).alias("p"))
    return p.groupBy("l_linenumber").agg(*(F.round(F.sum(F.col("p")[i]), 5).alias(f"p{i}") for i in range(3)))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    metric = F.when(F.col("p_partkey") % 4 == 0, "p_built").when(F.col("p_partkey") % 4 == 1, "height_m").when(F.col("p_partkey") % 4 == 2, "footprint_area_m2").otherwise("floors")
    value = F.when(F.col("p_partkey") % 9 > 0, F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") / 64).otherwise(F.col("p_size") * 128 + 0.5))
    return p.select("p_partkey", fn.answer_text(metric, value).alias("answer"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    own = F.map_filter(F.create_map(F.lit("name"), "p_name", F.lit("brand"), F.when(F.col("p_size") > 25, F.col("p_brand"))), lambda k, v: v.isNotNull())
    t = p.select("p_partkey", own.alias("own"), F.create_map(F.lit("brand"), F.lit("other"), F.lit("kind"), F.col("p_type")).alias("other"))
    f = fn.filled(F.col("own"), F.col("other"))
    return t.select("p_partkey", *(F.element_at(f, F.lit(k)).alias(k) for k in ("name", "brand", "kind")))


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of five kinds made from customers."""
    c, k = _t(spark, sf_dir, "customer"), F.col("c_custkey")
    s = k.cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit(" 33."), s, F.lit(", 35.5"))).when(k % 5 == 1, F.concat(F.lit("https://www.openstreetmap.org/way/"), s, F.lit("#map=17/33.9/35.5")))
        .when(k % 5 == 2, F.concat(F.lit("https://www.openstreetmap.org/#map=17/"), s, F.lit("/35.5"))).when(k % 5 == 3, F.concat(F.lit("https://www.openstreetmap.org/?mlat=1.5&mlon="), s)).otherwise(F.col("c_name"))
    )
    kind, point, words = fn.location("text")
    return c.withColumn("text", text).select("c_custkey", kind.alias("kind"), point["lat"].alias("lat"), point["lon"].alias("lon"), words.alias("words"))


B = "(select day(ts) as year_offset, event_type as kpi, median(value) as p50 from events where user_id % 2 = {o} group by 1, 2)"
QUERIES = {
    "scenario_changes": changes, "scenario_lever_issues": levers, "plan_candidates": candidates, "heights_resolved": heights, "union_without_known": known, "heights_companion": companions,
    "boxes_overlapping": boxes, "bounds_issues": bounds, "reviews_applied": reviews, "evidence_gaps": gaps, "rank_nearest_focus": focus, "text_citywide": citywide, "ids_of_records": record_ids,
    "noise_words": noise, "tags_heading": headings, "panel_years_since": since, "panel_normalised": normal, "question_answer_text": answers, "tags_filled": tags, "text_location": locations,
}
ORACLES = {
    "scenario_changes": f"select s.year_offset, s.kpi, round(s.p50, 6) as p50, round(u.p50, 6) as usual, round(s.p50 - u.p50, 6) as median_change from {B.format(o=1)} s left join {B.format(o=0)} u using (year_offset, kpi)",
    "scenario_lever_issues": """with l as (select s_suppkey % 90 as lever, round(s_acctbal / 2500, 2) as delta, s_suppkey % 5 as step, [s_suppkey, s_suppkey * 20] as o from supplier)
 select lever, 'delta' as rule from l where delta is null or abs(delta) > 3 or delta = 0 union select lever, 'step' from l where step < 0 or step >= 4 union select lever, 'repeated' from l group by lever having count(*) > 1
 union select lever, 'object' from (select lever, unnest(o) as i from l) where i not in (select c_custkey from customer)""",
    "plan_candidates": """with s as (select l_orderkey as c, round_even(sum(abs(l_discount - 0.05) * l_quantity), 6) as i from lineitem where l_linenumber <= 2 group by 1), m as (select o_orderkey as c, least(o_totalprice - 90000.0, 20.0 - day(o_orderdate)) as m from orders)
 select c as candidate, round(coalesce(i, 0), 5) as intensity, m >= 0 as feasible, round(m, 4) as least_margin from m left join s using (c)""",
    "heights_resolved": """with p as (select p_partkey, case when p_partkey % 3 = 0 and p_retailprice - 1000 > 0 and p_retailprice - 1000 <= 300 then p_retailprice - 1000 end as r, case when p_partkey % 4 = 0 and p_size > 0.99 and p_size <= 100 then p_size * 3.0::double end as f, case when p_partkey % 5 = 0 then 7.5::double end as m from part)
 select p_partkey, round(coalesce(r, f, m, 6.0), 4) as height, case when r is not null then 'recorded' when f is not null then 'floors' when m is not null then 'size_bin' else 'fallback' end as kind from p""",
    "union_without_known": "select 'known' as origin, count(*) as n, cast(sum(s_suppkey) as bigint) as ids from supplier union all select 'new', count(*), cast(sum(c_custkey) as bigint) from customer where c_custkey not in (select s_suppkey from supplier)",
    "heights_companion": "select p_partkey as id, case when p_size < 20 and s_acctbal is not null then s_acctbal else p_size end as height, case when p_size < 20 and s_acctbal is not null then 'companion' when p_size < 20 then 'fallback' else 'mapped' end as kind from part left join supplier on s_suppkey = p_partkey",
    "boxes_overlapping": f"with {P} select id from p where z >= 0 and x <= 0.5 and x + z >= -0.5 and y <= 0.5 and y + 0.5 >= -0.5",
    "bounds_issues": f"with {P}, b as (select x, y, case when id % 7 <> 0 then z end as x2, case when id % 5 = 0 then 'infinity'::double else x end as y2 from p) select case when x2 is null then 'missing' when isinf(y2) then 'not_finite' when x > x2 or y > y2 then 'not_ordered' end as issue, count(*) as n from b group by 1",
    "reviews_applied": """with p as (select distinct l_suppkey as photo, l_partkey as building from lineitem), k as (select *, case when building % 11 = 0 then building % 2 = 0 when photo % 6 = 0 then false end as keep, case when building % 11 = 0 then 'pair' when photo % 6 = 0 then 'photo' end as why from p)
 select case when keep is null then 'retained' when keep then 'kept' else 'excluded' end as status, case when not keep then why end as reason, count(*) as n from k group by 1, 2""",
    "evidence_gaps": "select case when q is null then 'none' when q < 1 then 'poor' else 'covered' end as reason, count(*) as n from documents d left join (select doc_id, max(quality) as q from labels group by 1) l using (doc_id) group by 1",
    "rank_nearest_focus": f"with {P}, d as (select id, sqrt((x - 0.2) ** 2 + (y + 0.1) ** 2) as dist from p) select id, round(dist, 6) as dist from d order by d.dist, id limit 12",
    "text_citywide": "select p_partkey, p_partkey % 3 < 2 as citywide from part",
    "ids_of_records": "select o_orderkey, case when o_orderkey % 3 = 0 then o_orderkey end as way, case when o_orderkey % 3 = 1 then 'way/' || o_orderkey end as osm from orders",
    "noise_words": """with e as (select (value - 40) / 10 as d from events) select case when abs(d) < 1 then 'No audible change' when abs(d) < 3 then 'Barely noticeable: slightly ' || w when abs(d) < 5 then 'Noticeable: ' || w when abs(d) < 10 then 'Clearly ' || w else 'Much ' || w end as words, count(*) as n, round(sum(pow(2.0, d / 10)), 3) as loudness
 from (select d, case when d > 0 then 'louder' else 'quieter' end as w from e) group by 1""",
    "tags_heading": "select c_custkey, case c_custkey % 4 when 0 then 45.0 when 1 then cast(((90 - c_custkey) % 360 + 360) % 360 as double) when 3 then 180.0 end as angle from customer",
    "panel_years_since": "select case when year(o_orderdate) <= 1998 then 1998 - year(o_orderdate) end as y, count(*) as n from orders group by 1",
    "panel_normalised": "with p as (select l_linenumber, l_discount as a, l_tax as b, l_discount + l_tax as s from lineitem) select l_linenumber, round(sum(case when s > 0 then a / s else 0::double end), 5) as p0, round(sum(case when s > 0 then b / s else 0::double end), 5) as p1, round(sum(case when s > 0 then 0::double else 1::double end), 5) as p2 from p group by 1",
    "question_answer_text": "select p_partkey, case when p_partkey % 9 = 0 then 'n/a' when p_partkey % 4 = 0 then cast(cast(round_even(p_size / 64.0 * 100, 0) as bigint) as varchar) || '%' when p_partkey % 4 = 1 then format('{:.1f} m', (p_size * 128 + 0.5)::double) when p_partkey % 4 = 2 then format('{:,} m²', p_size * 128) else cast(p_size * 128 as varchar) end as answer from part",
    "tags_filled": "select p_partkey, p_name as name, case when p_size > 25 then p_brand else 'other' end as brand, p_type as kind from part",
    "text_location": """select c_custkey, case c_custkey % 5 when 0 then 'point' when 1 then 'object' when 2 then case when c_custkey <= 90 then 'point' else 'none' end when 3 then case when c_custkey <= 180 then 'point' else 'none' end else 'query' end as kind,
 case c_custkey % 5 when 0 then cast('33.' || c_custkey as double) when 2 then case when c_custkey <= 90 then c_custkey::double end when 3 then case when c_custkey <= 180 then 1.5::double end end as lat,
 case c_custkey % 5 when 0 then 35.5::double when 2 then case when c_custkey <= 90 then 35.5::double end when 3 then case when c_custkey <= 180 then c_custkey::double end end as lon, case c_custkey % 5 when 1 then 'way/' || c_custkey when 4 then c_name end as words from customer""",
}
