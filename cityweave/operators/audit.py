"""Reconciliation, version diffs and integrity checks between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row as JSON in column order of names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that no order of rows changes: the eight words of the rows' digests are summed up, each on its
    own, and the sums are digested with the number of rows. Sums are combined before they are sent, no row is."""
    d = df.select(row_digest(df.columns).alias("d"))
    word = lambda i: F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("decimal(10,0)")
    sums = d.agg(F.count("*").alias("rows"), *(F.coalesce(F.sum(word(i)), F.lit(0)).cast("string").alias(f"w{i}") for i in range(8)))
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", *(f"w{i}" for i in range(8))), 256).alias("digest"))


def reconcile(left: DataFrame, right: DataFrame, key: str, values: list[str]) -> DataFrame:
    """One row: keys on the left only, right only, matched, and matched keys whose values drift, per value."""
    a = left.select(key, F.lit(True).alias("_a"), *(F.col(v).alias(f"_a_{v}") for v in values))
    b = right.select(key, F.lit(True).alias("_b"), *(F.col(v).alias(f"_b_{v}") for v in values))
    j = a.join(b, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.agg(
        F.count_if(F.col("_b").isNull()).alias("left_only"),
        F.count_if(F.col("_a").isNull()).alias("right_only"),
        F.count_if(both).alias("matched"),
        *(F.count_if(both & ~F.col(f"_a_{v}").eqNullSafe(F.col(f"_b_{v}"))).alias(f"{v}_drift") for v in values),
    )


def version_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed, changed or unchanged by row digest."""
    a = old.select(key, row_digest(old.columns).alias("_a"))
    b = new.select(key, row_digest(new.columns).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def field_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str], tolerance: float, allowed: DataFrame | None = None) -> DataFrame:
    """(key, field, before, after) of numeric fields that differ by more than the tolerance and are not allowed to."""
    long = lambda d, name: d.select(key, F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*(F.col(f).cast("double") for f in fields)))).alias("field", name))
    j = long(old, "before").join(long(new, "after"), [key, "field"])
    out = j.where(~(F.abs(F.col("after") - F.col("before")) <= tolerance) | (F.col("before").isNull() != F.col("after").isNull()))
    return out if allowed is None else out.join(allowed, [key, "field"], "left_anti")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys occur more than once, with that count."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return df.join(n, keys)


def coverage(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, rows, missing): nulls and blanks of every field in one pass."""
    made = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")).alias(f) for f in fields))
    pairs = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*fields))
    return made.select("rows", F.explode(pairs).alias("field", "missing")).select("field", "rows", "missing")


def exact_cover(queue: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """(key, issue): ids of the inventory that the queue misses, repeats, or that the inventory lacks."""
    n = queue.groupBy(key).agg(F.count("*").alias("n"))
    j = n.join(inventory.select(key, F.lit(True).alias("_i")), key, "full_outer")
    issue = F.when(F.col("n").isNull(), "missing").when(F.col("_i").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return j.select(key, issue.alias("issue")).where("issue is not null")


def dangling(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_anti")


def overlaps(intervals: DataFrame, key: str) -> DataFrame:
    """Intervals (start, end) that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("_e", F.max("end").over(w)).where(F.col("start") < F.col("_e")).drop("_e")


def profile(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension alone and in total, as grouping sets."""
    sets = [[F.col(d)] for d in dims] + [[]]
    return df.groupingSets(sets, *dims).agg(F.count("*").alias("n"))
