"""Queries of matching, statistics and map questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityweave.functions import columns as fn
from cityweave.operators import matching, osm, questions, stats
from cityweave.plans.spatial import grid, points


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "nation")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    return j.select(F.col("c_custkey").alias("object_id"), F.col("n_name").alias("sector"), F.col("c_mktsegment").alias("use"), F.col("c_acctbal").alias("balance"))


def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions.Question("rank", "balance", {"use": ("furniture",)}, at_least=100, limit=15)
    return questions.answer(q, customers(spark, sf_dir))


def by_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions.Question("by_sector", "balance", {"use": ("furniture", "machinery")})
    return questions.answer(q, customers(spark, sf_dir)).withColumn("mean", F.round("mean", 6))


def one_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers by quantity sold together, best first, each once."""
    li = _t(spark, sf_dir, "lineitem")
    pairs = li.groupBy((F.col("l_partkey") % 60).alias("a"), (F.col("l_suppkey") % 40).alias("b")).agg(F.sum("l_quantity").alias("score"))
    return matching.one_to_one(pairs)


def conservative(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    pairs = li.groupBy((F.col("l_partkey") % 300).alias("a"), (F.col("l_suppkey") % 97).alias("b")).agg(F.sum("l_quantity").alias("score"))
    return matching.conservative(pairs, 5.0)


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names against the names and types of all parts."""
    p = _t(spark, sf_dir, "part")
    a = p.groupBy("p_name").agg(F.min("p_partkey").alias("id")).select("id", fn.tokens("p_name").alias("words"))
    b = p.select(F.col("p_partkey").alias("id"), F.array_union(fn.tokens("p_name"), fn.tokens("p_type")).alias("words"))
    return matching.contained_tokens(a, b)


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return matching.quantised(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["x", "y"], 0, True).groupBy(F.bround("x", 0).alias("x"), F.bround("y", 0).alias("y")).agg(F.count("*").alias("n"))


def height_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.bin_medians(_t(spark, sf_dir, "part"), "p_retailprice", "p_size", [5, 10, 20, 30, 45, 51])
    return out.withColumn("median", F.round("median", 6))


def height_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("floors"), (F.col("p_size") * 3.0 + F.col("p_retailprice") % 7).alias("height"))
    return stats.height_models(p).select("model", "n", *(F.round(c, 5).alias(c) for c in ("median_abs", "mae", "bias", "p90_abs")))


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    return stats.best_shift(g.where("z > 1"), g.where("z < 0.5"), 2).withColumn("share", F.round("share", 9))


def bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.sampled_bilinear(points(spark, sf_dir), grid(spark, sf_dir), 0.25).where("z is not null")
    return out.withColumn("z", F.round("z", 5))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.block_folds(points(spark, sf_dir), 1.0, 5).groupBy("fold").agg(F.count("*").alias("n"))


def disruptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("road"), (F.col("value") > 250).alias("closed"), F.round(1 / (1 + F.col("value")), 9).alias("factor"), F.col("event_type").alias("reason"))
    a, b = (e.where(F.col("reason") == r).groupBy("road", "reason").agg(F.max("closed").alias("closed"), F.min("factor").alias("factor")) for r in ("error", "view"))
    return osm.combined_disruptions([a, b])


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points every 0.2 along each user's path of the day and value of all events."""
    e = _t(spark, sf_dir, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    line = e.select(F.col("user_id").alias("id"), F.col("rank").alias("seq"), (F.col("value") / 50).alias("x"), (F.dayofmonth("ts") / 3).alias("y"))
    return osm.line_samples(line, 0.2).groupBy("id").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sx"), F.round(F.sum("y"), 4).alias("sy"))


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_sample(_t(spark, sf_dir, "supplier").select("s_suppkey", F.greatest("s_acctbal", F.lit(0.0)).alias("w")), "s_suppkey", "w", 20)


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fleet(_t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 10).alias("e")), "e", "p_partkey")


P = "p as (select vec_id as id, cast(embedding[1] as double) * 10 as x, cast(embedding[2] as double) * 10 as y, cast(embedding[3] as double) * 10 as z from embeddings)"
G = f"{P}, g as (select cast(floor(y / 0.25) as bigint) as row, cast(floor(x / 0.25) as bigint) as col, round(max(z), 6) as z from p group by 1, 2)"
QUERIES = {
    "question_rank": rank, "question_by_sector": by_sector, "match_one_to_one": one_to_one, "match_conservative": conservative, "match_contained_tokens": contained,
    "match_quantised": quantised, "stats_bin_medians": height_bins, "stats_height_models": height_models, "grid_best_shift": shifts, "grid_bilinear": bilinear,
    "stats_block_folds": folds, "union_disruptions": disruptions, "line_samples": samples, "stats_weighted_sample": weighted, "stats_fleet": fleet,
}
WORDS = "list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> ''))"
ORACLES = {
    "question_rank": "select c_custkey as object_id, n_name as sector, c_acctbal as balance from customer join nation on c_nationkey = n_nationkey where lower(c_mktsegment) = 'furniture' and c_acctbal >= 100 order by c_acctbal desc, c_custkey limit 15",
    "question_by_sector": "select n_name as sector, count(*) as n, round(avg(c_acctbal), 6) as mean from customer join nation on c_nationkey = n_nationkey where lower(c_mktsegment) in ('furniture', 'machinery') group by 1",
    "match_conservative": """with s as (select l_partkey % 300 as a, l_suppkey % 97 as b, sum(l_quantity) as score from lineitem group by 1, 2), r as (select *, row_number() over w as r, lead(score) over w as nxt from s window w as (partition by a order by score desc, b)),
 c as (select * from r where r = 1 and (nxt is null or score - nxt >= 5)) select a, b, score from c where b in (select b from c group by b having count(*) = 1)""",
    "match_contained_tokens": f"with a as (select p_partkey as id, {WORDS.format(c='p_name')} as w from (select p_name, min(p_partkey) as p_partkey from part group by 1)), b as (select p_partkey as other, list_concat({WORDS.format(c='p_name')}, {WORDS.format(c='p_type')}) as w from part) select id, other from a join b on list_has_all(b.w, a.w) where len(a.w) > 0",
    "match_quantised": f"with {P}, q as (select id, round_even(x, 0) as x, round_even(y, 0) as y from p) select x, y, count(*) as n from q where id % 2 = 0 and (x, y) in (select (x, y) from q where id % 2 = 1) group by 1, 2",
    "stats_bin_medians": """with b as (select case when p_size >= 51 then 6 when p_size >= 45 then 5 when p_size >= 30 then 4 when p_size >= 20 then 3 when p_size >= 10 then 2 when p_size >= 5 then 1 else 0 end as bin, p_retailprice as v from part),
 n as (select bin, count(*) as n, quantile_cont(v, 0.5) as m from b group by 1), w as (select quantile_cont(v, 0.5) as m from b) select cast(r.range as int) as bin, coalesce(n.n, 0) as n, round(case when n.n >= 5 then n.m else w.m end, 6) as median from range(7) r left join n on n.bin = r.range, w""",
    "stats_height_models": """with r as (select cast(p_partkey % 5 as int) as fold, cast(p_size as double) as f, cast(p_size * 3.0 as double) + fmod(p_retailprice, 7) as h from part where p_size > 0),
 fit as (select k.range as fold, quantile_cont(h / f, 0.5) as ratio, regr_slope(h, f) as s, regr_intercept(h, f) as i from r, range(5) k where r.fold <> k.range group by 1),
 e as (select unnest(['constant', 'ratio', 'least_squares']) as model, unnest([f * 3.2 - h, f * ratio - h, i + s * f - h]) as e from r join fit using (fold))
 select model, count(*) as n, round(quantile_cont(abs(e), 0.5), 5) as median_abs, round(avg(abs(e)), 5) as mae, round(avg(e), 5) as bias, round(quantile_cont(abs(e), 0.9), 5) as p90_abs from e group by 1""",
    "grid_best_shift": f"with {G} select cast(dx.range - 2 as int) as dx, cast(dy.range - 2 as int) as dy, round(avg(case when b.row is null then 0 else 1 end), 9) as share from (select * from g where z > 1) a cross join range(5) dx cross join range(5) dy left join (select * from g where z < 0.5) b on b.row = a.row + dy.range - 2 and b.col = a.col + dx.range - 2 group by 1, 2",
    "grid_bilinear": f"""with {G}, q as (select id, x / 0.25 - 0.5 as gx, y / 0.25 - 0.5 as gy from p), c as (select id, cast(floor(gx) as bigint) + i.range as col, cast(floor(gy) as bigint) + j.range as row, (case when i.range = 1 then gx - floor(gx) else 1 - gx + floor(gx) end) * (case when j.range = 1 then gy - floor(gy) else 1 - gy + floor(gy) end) as w from q, range(2) i, range(2) j)
 select id, round(sum(z * w), 5) as z from c join g using (row, col) group by 1 having count(*) = 4""",
    "stats_block_folds": f"with {P}, n as (select floor(x) as tx, floor(y) as ty, count(*) as n from p group by 1, 2), t as (select *, (row_number() over (order by n desc, tx, ty) - 1) % 10 as k from n) select cast(case when k < 5 then k else 9 - k end as int) as fold, cast(sum(n) as bigint) as n from t group by 1",
    "union_disruptions": "select user_id % 50 as road, max(value > 250) as closed, min(round(1 / (1 + value), 9)) as factor, arg_min(event_type, case event_type when 'error' then 0 else 1 end) as reason from events where event_type in ('error', 'view') group by 1",
}
