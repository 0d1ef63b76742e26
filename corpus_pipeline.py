"""The corpus pipeline: toxicity, line dedup, near-dedup, mixing and BPE encoding over `documents`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.

Columns are found by their exact names and travel under numbers inside a stage, so extra columns of any name pass
through untouched, also such as differ from others in letter case only. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityweave.llm import bpe, line_dedup, mixing, simhash, toxicity
from cityweave.llm.common import broadcast_if_small, dropped, hot_keys, numbered, release, spread_join, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled documents that are not held out.

    Null and empty texts score by the model's constant alone, very long ones as a whole. Rows are judged one by one, so
    equal rows share their fate and null ids do no harm. A score equal to the threshold rejects. Without labels of both
    kinds nothing tells toxic texts from others, every score is the same constant of one half at most and all documents
    stay."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain, at = numbered(docs)
    out = toxicity.scored(plain, model, text=at["text"], column="score")
    return out.where(F.col("score") < toxicity.THRESHOLD).drop("score").toDF(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sources go from the text; n_chars, where there is one, follows it.

    Null texts stay null with a null n_chars, empty ones empty; no document goes, not even one that loses all its lines.
    A line on exactly the threshold's number of sources goes. Equal rows are stripped alike; a null source counts for
    none, a null id plays no part."""
    plain, at = numbered(docs)
    out = line_dedup.remove_boilerplate(plain, text=at["text"], site=at["source"])
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.length(at["text"]).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id. Near copies are linked by SimHash
    fingerprints at most three bits apart, found through operator 8's Gray-order index, and besides by shingle sets of
    Jaccard similarity of at least 0.8, which 64 bits cannot tell from less.

    Rows are told apart by id and text together: of rows with one id only those that are copies go, and of rows equal in
    both one stays, whichever has the least hash of all columns. Null and wordless texts are no copies of each other and
    stay. A null id is kept only where no member of the group has an id; of equal ids, the text of least digest stays.
    Whole texts count, however long."""
    plain, at = numbered(docs)
    key, text, every = F.col(at["doc_id"]), at["text"], plain.columns
    body = F.when(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.unhex(F.md5(text)))
    row = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.hex(body), F.xxhash64(*every).cast("string")), key.cast("string"))))
    rows = plain.select(key.alias("id"), body.alias("body"), row.alias("row")).where("body is not null")
    rows = staged(rows.groupBy("id", "body", "row").agg(F.count("*").alias("n")), "rows-of-texts")
    groups = simhash.near_groups(plain.select(body.alias("body"), text).where("body is not null"), key="body", text=text)
    groups = staged(groups, "text-groups")
    hot = hot_keys(rows.groupBy("body").agg(F.count("*").alias("m")), ["body"], "m", rows.count())
    members = staged(spread_join(rows, groups, ["body"], staged(hot, "hot-texts")), "members")
    order = F.struct(F.col("id").isNull().alias("null"), "id", "body", "row", "n")
    stay = members.groupBy("component_id").agg(F.sum("n").alias("all"), F.min(order).alias("one")).where("all > 1")
    stay = staged(stay.select("component_id", "one.row", "one.n"), "stay")
    sizes = members.groupBy("component_id").agg(F.count("*").alias("m")).where("m > 1")
    hot = staged(hot_keys(sizes, ["component_id"], "m", members.count()), "hot-groups")
    several = spread_join(members, stay.select("component_id"), ["component_id"], hot, "left_semi").select("row")
    gone = staged(several.join(stay, "row", "left_anti"), "gone")
    for old in (rows, groups, members):
        dropped(spark, old)
    release(spark)
    out = plain.withColumn("row", row).join(broadcast_if_small(gone), "row", "left_anti")
    twice = stay.where("n > 1").select("row")
    if not twice.isEmpty():
        least = F.min_by(F.struct(*every), F.xxhash64(*every)).alias("one")
        one = out.join(twice, "row", "left_semi").groupBy("row").agg(least).select("one.*")
        out = out.join(twice, "row", "left_anti").select(*every).unionAll(one)
    return out.select(*every).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; sources weigh as the square root of their documents.

    No row is dropped or repeated, whatever its text or id. A null source is a source of its own; equal rows stand next
    to each other in the order of their source."""
    return mixing.mixed_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of ids and decoded text of every document kept.

    Null and empty texts have no tokens and the digests of nothing; whole texts are encoded, however long. Equal rows and
    null ids give a row each."""
    return bpe.encode_documents(docs, bpe.default_tokenizer(), outputs=("ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: SQL can't express the classifier, the copies and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
