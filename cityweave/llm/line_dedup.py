"""Operator 3: cross-site boilerplate lines, by distinct-site spread.

Lines are hashed once into a narrow table (two 64-bit hashes, the site and a count), a row for each line and site; it is
pre-aggregated before its shuffle, so a line that stands in a third of all documents costs one row a task and site. An
aggregate of it drops lines seen fewer times than the threshold or on one site only. For the lines left, HyperLogLog
sketches of the sites merge by aggregation; a line on a large share of all (line, site) rows is dealt over tasks.
Lines whose estimate lies within the sketch's error of the threshold get an exact distinct count. Lines at or over the
threshold go from every document.

The set of such lines is broadcast only while its counted size is under a bound; beyond that it is joined by hash, and
the hashes found are brought back to their texts.

Defined cases: a null text has no lines, stays null and gives zero counts; blank lines are never boilerplate; a null
site counts for none; lines are compared without the spaces around them; equal rows give equal results; an empty table
gives an empty result; all columns besides the text stay as they are.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cityweave.llm.common import columns_of, hot_keys, numbered, spread_join, staged

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's buckets; its relative error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12
#: So many hashes at most (16 bytes each) are broadcast.
BROADCAST_LINES = 200_000


def _hashes(line) -> list:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, line).alias("h2")]


def site_spread(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """(h1, h2) of the lines that stand on at least min_sites distinct sites."""
    docs = columns_of(docs, text, site).toDF("text", "site")
    lines = docs.select("site", F.explode(F.split("text", "\n")).alias("line")).select("site", F.trim("line").alias("line"))
    seen = lines.where("line <> '' and site is not null").select(*_hashes(F.col("line")), "site")
    seen = staged(seen.groupBy("h1", "h2", "site").agg(F.count("*").alias("n")), "lines")
    often = (
        seen.groupBy("h1", "h2")
        .agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.min("site").alias("lo"), F.max("site").alias("hi"))
        .where((F.col("n") >= min_sites) & (F.lit(min_sites <= 1) | (F.col("lo") != F.col("hi"))))
        .select("h1", "h2", "rows")
    )
    often = staged(often, "lines-often")
    hot = staged(hot_keys(often, ["h1", "h2"], "rows", seen.count()), "lines-hot")
    some = spread_join(seen, often.select("h1", "h2"), ["h1", "h2"], hot, "left_semi")
    sketch = some.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    sketch = staged(sketch.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")), "line-sites")
    margin = max(1.0, 3 * 1.04 / 2 ** (LG_K / 2) * min_sites)
    near = sketch.where(F.abs(F.col("sites") - min_sites) <= margin).select("h1", "h2")
    exact = (
        spread_join(seen, near, ["h1", "h2"], hot, "left_semi")
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("sites"))
        .where(F.col("sites") >= min_sites)
    )
    sure = sketch.where(F.col("sites") > min_sites + margin)
    return staged(sure.select("h1", "h2").unionAll(exact.select("h1", "h2")), "boilerplate")


def _strip_by_broadcast(docs: DataFrame, spread: DataFrame, text: str, schema: T.StructType, report: bool) -> DataFrame:
    spark, place = docs.sparkSession, docs.columns.index(text)
    known = spark.sparkContext.broadcast({(r.h1 % (1 << 64), r.h2 % (1 << 64)) for r in spread.toLocalIterator()})

    def run(batches):
        bad, digest = known.value, xxhash.xxh64_intdigest

        def flagged(line: str) -> bool:
            raw = line.strip(" ").encode()
            h = digest(raw, 42)
            return (h, digest(raw, h)) in bad

        for batch in batches:
            texts, total, gone = [], [], []
            for value in batch.column(place):
                lines = value.as_py().split("\n") if value.is_valid else []
                kept = [x for x in lines if not flagged(x)]
                texts.append("\n".join(kept) if value.is_valid else None)
                total.append(len(lines))
                gone.append(len(lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            if report:
                columns += [pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, schema)


def _strip_by_join(docs: DataFrame, spread: DataFrame, text: str, schema: T.StructType, report: bool) -> DataFrame:
    place = docs.columns.index(text)
    plain = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    body = F.col(f"_{place}")
    key = [F.xxhash64(body).alias("k1"), F.xxhash64(body, body).alias("k2")]
    lines = plain.select(*key, F.explode(F.split(body, "\n")).alias("line")).select("k1", "k2", *_hashes(F.trim("line")))
    found = lines.join(spread, ["h1", "h2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("h1", "h2")).alias("bad"))
    joined = plain.withColumns({"k1": key[0], "k2": key[1]}).join(found, ["k1", "k2"], "left")
    every = F.split(body, "\n")
    kept = F.filter(
        every, lambda x: F.col("bad").isNull() | ~F.array_contains(F.col("bad"), F.struct(*_hashes(F.trim(x))))
    )
    out = [F.array_join(kept, "\n") if i == place else F.col(f"_{i}") for i in range(len(docs.columns))]
    if report:
        size = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
        total = F.when(body.isNull(), 0).otherwise(size(every)).cast("long")
        left = F.when(body.isNull(), 0).otherwise(size(kept)).cast("long")
        out += [total, total - left]
    return joined.select(*out).toDF(*schema.names)


def remove_boilerplate(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    text: str = "text",
    site: str = "source",
    report: bool = False,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """docs with their boilerplate lines taken out of the text; with report also n_lines and n_removed."""
    spread = site_spread(docs, min_sites, text, site)
    plain, at = numbered(docs)
    fields = [T.StructField(f.name, T.StringType()) if f.name == at[text] else f for f in plain.schema.fields]
    more = ["n_lines", "n_removed"] if report else []
    fields += [T.StructField(f"_{name}", T.LongType()) for name in more]
    strip = _strip_by_broadcast if spread.count() <= broadcast_lines else _strip_by_join
    return strip(plain, spread, at[text], T.StructType(fields), report).toDF(*docs.columns, *more)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = columns_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source")
    out = remove_boilerplate(docs, report=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLES = {
    "op3_line_dedup": """
with d as (select row_number() over () as r, doc_id, text, source from documents),
l as (
  select r, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i
  from d where text is not null
),
bad as (select trim(line) as line from l where trim(line) <> '' group by 1 having count(distinct source) >= 10),
g as (
  select l.r, count(*) as n_lines, count(bad.line) as n_removed,
         string_agg(l.line, chr(10) order by l.i) filter (where bad.line is null) as kept
  from l left join bad on trim(l.line) = bad.line group by 1
)
select d.doc_id, cast(coalesce(n_lines, 0) as bigint) as n_lines, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from d left join g using (r)
"""
}
