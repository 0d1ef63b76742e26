"""Operator 12 [native]: document fingerprints by consistent weighted sampling.

A document's weighted terms are its words (lower-cased, parted by white space) with their numbers of occurrences. For each
of SAMPLES hash functions a term draws r and c from a gamma distribution of shape 2 (minus the logarithm of the product of
two uniform numbers) and an offset b, all from hashes of the term alone; with weight w it takes t = floor(ln w / r + b),
and its rank is ln c - r * (t - b + 1). A document's sample is the term and t of least rank. Two documents take the same
sample with a probability of the sum of the lesser weights over the sum of the greater ones: generalised Jaccard
similarity. As a rank follows from term and t, the least rank itself names the sample; a fingerprint holds 32 bits of a
hash of each, and the share of equal places is the estimate (standard error at most 0.09 for 32 samples).

Only DataFrame functions are used. Terms are counted and sampled inside the partition that holds their text, so no row
for a term is ever shuffled; copies of a row are dropped before texts move. For edited texts each text moves once to its own key and its beginning once more to the
document before it; the order of documents is found on (id, hashes, length) alone, ranges sorted apart and their ends put
together. Nothing is broadcast but what Spark itself finds small.

Defined cases: a null text counts as empty; texts without words have equal fingerprints, unlike any other; null ids come
first in the order and stay null; rows that are equal in id and text stand side by side, so each but the last has its own
text as next; rows of one id are ordered by a hash of their text; of a single document the next one is itself; an empty
table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cityweave.llm.common import columns_of, partitions_for, staged

SAMPLES = 32
#: White space that parts words.
BLANKS = r"[ \t\n\x0B\f\r]+"
#: A document by its id (a null one as the least) and a hash of its text and of whether the id is null.
KEY = ["id", "h"]
LEAST = -(1 << 63)


def _part(h: Column, place: int, bits: int) -> Column:
    """A uniform number in (0, 1) from so many bits of a hash."""
    whole = F.shiftrightunsigned(h, place).bitwiseAND(F.lit((1 << bits) - 1))
    return (whole + F.lit(0.5)) * F.lit(2.0**-bits)


def ranks(term: Column, log_weights: list[Column], k: int) -> list[Column]:
    """Rank of a term in the k-th sample at each of the logarithms of weights; the least rank of a document names its
    sample. Products of two numbers of 12 bits give the gamma draws steps of some 2 ** -24."""
    h = F.xxhash64(term, F.lit(k))
    r = -F.ln(_part(h, 0, 12) * _part(h, 12, 12))
    c = -F.ln(_part(h, 24, 12) * _part(h, 36, 12))
    b = _part(h, 48, 16)
    at_one = F.ln(c) - r * (F.lit(1.0) - b)
    return [F.when(w == 0.0, at_one).otherwise(at_one - r * F.floor(w / r + b)) for w in log_weights]


def sampled(least: list[Column]) -> Column:
    """array<int> of least ranks, 32 bits of a hash of each."""
    low = lambda h: (F.pmod(h, F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")
    return F.array(*(low(F.xxhash64(x)) for x in least))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal places of two fingerprints (arrays), the estimate of generalised Jaccard similarity."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(fingerprint: Column | str) -> Column:
    """A fingerprint as hexadecimal digits, eight a sample."""
    one = lambda x: F.lpad(F.lower(F.hex(x.cast("long") + F.lit(1 << 31))), 8, "0")
    return F.array_join(F.transform(fingerprint, one), "")


def words(text: Column) -> Column:
    """The words of a text; one empty word where there are none."""
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), BLANKS)


def weighted_signatures(terms: DataFrame, by: list[str], weights: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """(by, one fingerprint for each entry of weights) from rows (by, term, weight columns): `weights` maps the name of a
    fingerprint to the column with its weights, any positive numbers; a term of weight 0 or null does not count."""
    logs = {name: F.when(F.col(w) > 0, F.ln(w)) for name, w in weights.items()}
    named = terms.select(*by, F.xxhash64("term").alias("term"), *(e.alias(f"_{n}") for n, e in logs.items()))
    columns = [F.col(f"_{n}") for n in weights]
    least = [F.min(x).alias(f"_{n}_{k}") for k in range(samples) for n, x in zip(weights, ranks(F.col("term"), columns, k))]
    out = named.groupBy(*by).agg(*least)
    return out.select(*by, *(sampled([F.col(f"_{n}_{k}") for k in range(samples)]).alias(n) for n in weights))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(key, fingerprint array<int>), a row for each row of docs."""
    rows = columns_of(docs, key, text).toDF("key", "text")
    kind = [F.xxhash64("text").alias("h1"), F.xxhash64("text", "text").alias("h2")]
    rows = rows.select("key", F.coalesce("text", F.lit("")).alias("text")).select("key", "text", *kind)
    once = rows.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    terms = once.select("h1", "h2", F.explode(words(F.col("text"))).alias("term"))
    counted = terms.groupBy("h1", "h2", "term").agg(F.count(F.nullif("term", F.lit(""))).alias("n"))
    made = weighted_signatures(counted, ["h1", "h2"], {"fingerprint": "n"}, samples)
    return rows.select("key", "h1", "h2").join(made, ["h1", "h2"]).select(F.col("key").alias(key), "fingerprint")


def followers(rows: DataFrame) -> DataFrame:
    """(KEY, next_id, next_h): for each distinct key the one after it in ascending order, for the last the first."""
    spark = rows.sparkSession
    ranges = partitions_for(spark, rows.count(), 500_000)
    ordered = staged(rows.select(*KEY).repartitionByRange(ranges, *KEY).select(*KEY, F.spark_partition_id().alias("p")), "order")
    heads = ordered.groupBy("p").agg(F.min(F.struct(*KEY)).alias("head"))  # a row for each range
    after = F.coalesce(F.lead("head").over(Window.orderBy("p")), F.min("head").over(Window.partitionBy()))
    own = F.lead(F.struct(*KEY)).over(Window.partitionBy("p").orderBy(*KEY))
    linked = ordered.select(*KEY, "p", own.alias("own")).join(F.broadcast(heads.select("p", after.alias("after"))), "p")
    to = F.coalesce("own", "after")
    return linked.select(*KEY, *(to[c].alias(f"next_{c}") for c in KEY))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against
    its edited form, whose last half is replaced by the beginning of the next document, and against that document."""
    rows = columns_of(docs, key, text).toDF("key", "text").withColumn("text", F.coalesce("text", F.lit("")))
    ids = [F.coalesce("key", F.lit(LEAST)).cast("long").alias("id"), F.xxhash64("text", F.col("key").isNull()).alias("h")]
    rows = rows.select(*ids, "key", "text")
    counted = rows.groupBy(*KEY, "key", F.char_length("text").alias("n")).agg(F.count("*").alias("copies"))
    counted = staged(counted, "documents")
    jobs = staged(counted.join(followers(counted), KEY), "pairs")
    half = F.floor(F.col("n") / 2).cast("int")
    once = rows.select(*KEY, "text").dropDuplicates(KEY)
    asked = jobs.select(*(F.col(f"next_{c}").alias(c) for c in KEY), *(F.col(c).alias(f"to_{c}") for c in KEY), half.alias("half"))
    begun = lambda size: F.substring("text", F.lit(1), size)
    given = once.join(asked, KEY).select(*(F.col(f"to_{c}").alias(c) for c in KEY), begun(F.col("half")).alias("given"))
    both = once.join(jobs, KEY).join(given, KEY)
    linked = [*(f"next_{c}" for c in KEY), "key", "n", "copies"]
    # all copies of a row but the last are followed by their own text
    version = lambda own, head: F.struct(F.lit(own).alias("own"), F.concat(begun(F.col("n") - half), head).alias("edited"))
    last, earlier = version(False, F.col("given")), version(True, begun(half))
    versions = F.when(F.col("copies") > 1, F.array(last, earlier)).otherwise(F.array(last))
    both = both.select(*KEY, *linked, "text", F.explode(versions).alias("v")).select(*KEY, "v.own", *linked, "text", "v.edited")
    by = [*KEY, "own"]
    one = lambda side, column: F.struct(F.lit(side == "text").cast("int").alias("a"), F.lit(side != "text").cast("int").alias("b"), F.col(column).alias("text"))
    sides = both.select(*by, F.explode(F.array(one("text", "text"), one("edited", "edited"))).alias("side"))
    terms = sides.select(*by, "side.a", "side.b", F.explode(words(F.col("side.text"))).alias("term"))
    told = (F.col("term") != "").cast("int")
    terms = terms.select(*by, F.xxhash64("term").alias("term"), (F.col("a") * told).alias("a"), (F.col("b") * told).alias("b"))
    terms = terms.groupBy(*by, "term").agg(F.sum("a").alias("n_text"), F.sum("b").alias("n_edited"))
    made = weighted_signatures(terms, by, {"fingerprint": "n_text", "edited_fingerprint": "n_edited"}, samples)
    told_of = both.select(*by, *linked, F.unhex(F.sha2("edited", 256)).alias("sha"))
    made = staged(made.join(told_of, by), "fingerprints")
    theirs = made.where("not own").select(*(F.col(c).alias(f"next_{c}") for c in KEY), F.col("fingerprint").alias("next_fingerprint"))
    own = F.when(F.col("own"), F.col("fingerprint")).otherwise(F.col("next_fingerprint"))
    out = made.join(theirs, [f"next_{c}" for c in KEY]).withColumn("next_fingerprint", own)
    times = F.when(F.col("own"), F.col("copies") - 1).otherwise(F.lit(1))
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1), times.cast("int"))))
    return out.select(
        F.col("key").alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        as_text("fingerprint").alias("fingerprint"),
        as_text("edited_fingerprint").alias("edited_fingerprint"),
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )


def op12_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_weighted_sampling": op12_weighted_sampling}
ORACLES: dict[str, str] = {}
