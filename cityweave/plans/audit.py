"""Reconciliation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.functions import columns as fn
from cityweave.operators import audit as op


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by segment against the segments their orders suggest: keys on one side and values that drift."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 7).alias("v"))
    o = _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.min("o_orderkey") % 7).alias("v"))
    return op.reconcile(c, o, "k", ["v"])


def version_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _t(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 11 <> 0")
    new = s.where("s_suppkey % 13 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 5 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return op.version_diff(old, new, "s_suppkey")


def field_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    new = p.withColumns({"p_size": F.col("p_size") + (F.col("p_partkey") % 9 == 0).cast("int"), "p_retailprice": F.col("p_retailprice") + F.col("p_partkey") % 4 * 0.01})
    return op.field_diff(p, new, "p_partkey", ["p_size", "p_retailprice"], 0.025).select("p_partkey", "field", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return op.coverage(d, ["text", "lang", "source", "quality", "toxic"])


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as a queue over all documents."""
    queue = _t(spark, sf_dir, "labels").select("doc_id").unionAll(_t(spark, sf_dir, "labels").where("doc_id % 10 = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 20 == 0, 1_000_000).otherwise(0)).alias("doc_id")))
    return op.exact_cover(queue, _t(spark, sf_dir, "documents"), "doc_id").groupBy("issue").agg(F.count("*").alias("n"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.profile(_t(spark, sf_dir, "part").select("p_brand", "p_type"), ["p_brand", "p_type"])


def dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return op.dangling(c, _t(spark, sf_dir, "orders").where("o_orderkey % 5 = 0"), "o_custkey", "o_custkey")


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer that were placed within 30 days after an earlier one."""
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("start"))
    o = o.withColumn("end", F.date_add("start", 30))
    return op.overlaps(o, "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", fn.label_key("p_brand").alias("key"), F.array_join(F.array_sort(fn.tokens("p_name", ("hot",))), "|").alias("words"), F.array_join(F.transform(fn.numbers_in("p_brand"), lambda x: x.cast("int").cast("string")), ",").alias("numbers"))


def props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k_sum"), F.count_if(k.isNull()).alias("k_missing"))


def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.floor(F.sum("o_totalprice") / 100).alias("people"))
    return c.select("o_custkey", fn.rounded_people(F.col("people")).alias("people"))


QUERIES = {
    "audit_reconcile": reconcile, "audit_version_diff": version_diff, "audit_field_diff": field_diff, "audit_coverage": coverage, "audit_exact_cover": cover,
    "audit_profile": profile, "audit_dangling": dangling, "audit_overlaps": overlaps, "text_name_tokens": names, "json_props": props, "rounded_people": rounding,
}
ORACLES = {
    "audit_reconcile": """select cast(count(*) filter (o.k is null) as bigint) as left_only, count(*) filter (c.k is null) as right_only, count(*) filter (o.k = c.k) as matched, count(*) filter (o.k = c.k and o.v is distinct from c.v) as v_drift
 from (select c_custkey as k, c_custkey % 7 as v from customer) c full join (select o_custkey as k, min(o_orderkey) % 7 as v from orders group by 1) o on c.k = o.k""",
    "audit_version_diff": "select s_suppkey, case when s_suppkey % 11 = 0 then 'added' when s_suppkey % 13 = 0 then 'removed' when s_suppkey % 5 = 0 then 'changed' else 'unchanged' end as change from supplier where s_suppkey % 11 <> 0 or s_suppkey % 13 <> 0",
    "audit_field_diff": """select p_partkey, 'p_size' as field, round(p_size, 4) as before, round(p_size + 1, 4) as after from (select p_partkey, cast(p_size as double) as p_size from part) where p_partkey % 9 = 0
 union all select p_partkey, 'p_retailprice', round(p_retailprice, 4), round(p_retailprice + 0.03, 4) from part where p_partkey % 4 = 3""",
    "audit_coverage": """with j as (select text, lang, source, cast(quality as varchar) as quality, cast(toxic as varchar) as toxic from documents left join labels using (doc_id)),
 u as (unpivot (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(quality, '') as quality, coalesce(toxic, '') as toxic from j) on text, lang, source, quality, toxic into name field value v)
 select field, count(*) as rows, count(*) filter (trim(v) = '') as missing from u group by 1""",
    "audit_exact_cover": """with q as (select doc_id from labels union all select doc_id + case when doc_id % 20 = 0 then 1000000 else 0 end from labels where doc_id % 10 = 0), n as (select doc_id, count(*) as n from q group by 1),
 i as (select case when n is null then 'missing' when d.doc_id is null then 'unexpected' when n > 1 then 'repeated' end as issue from n full join documents d using (doc_id)) select issue, count(*) as n from i where issue is not null group by 1""",
    "audit_profile": "select p_brand, p_type, count(*) as n from part group by grouping sets ((p_brand), (p_type), ())",
    "audit_dangling": "select c_custkey as o_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderkey % 5 = 0)",
    "audit_overlaps": """with o as (select o_custkey, cast(o_orderdate as date) as s, cast(o_orderdate as date) + 30 as e, o_orderkey from orders),
 p as (select *, max(e) over (partition by o_custkey order by s, e rows between unbounded preceding and 1 preceding) as m from o) select o_custkey, count(*) as n from p where s < m group by 1""",
    "text_name_tokens": """select p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) as key, array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '' and x <> 'hot'))), '|') as words,
 array_to_string(regexp_extract_all(p_brand, '[0-9]+'), ',') as numbers from part""",
    "json_props": "select event_type, count(*) as n, cast(sum(cast(json_extract_string(props, '$.k') as int)) as bigint) as k_sum, count(*) filter (json_extract_string(props, '$.k') is null) as k_missing from events group by 1",
    "rounded_people": """with c as (select o_custkey, floor(sum(o_totalprice) / 100) as n from orders group by 1), s as (select *, case when n < 100 then 1 when n < 1000 then 10 when n < 10000 then 100 else 1000 end as step from c)
 select o_custkey, cast(round_even(n / step, 0) * step as bigint) as people from s""",
}
