"""Ranked, cumulative and order-dependent rules."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of every key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rank_quantile(df: DataFrame, keys: list[str], value: str, q: float, upper: bool = False) -> DataFrame:
    """An observed value at a rank: the lower neighbour of the quantile's place, or the upper one. Ranks run over counts of
    equal values, so a key brings its distinct values together, not its rows."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys)
    place = q * (F.sum("_n").over(w) - 1)
    last = F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    r = c.withColumns({"_at": F.ceil(place) if upper else F.floor(place), "_last": last})
    return r.where((F.col("_at") < F.col("_last")) & (F.col("_at") >= F.col("_last") - F.col("_n"))).select(*keys, F.col(value).alias("value"))


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds each row's share of its group and the running share in order of size."""
    w = Window.partitionBy(*keys)
    running = w.orderBy(F.desc(value), *[c for c in df.columns if c not in keys and c != value]).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(w)
    return df.withColumns({"share": F.col(value) / total, "running_share": F.sum(value).over(running) / total})


def admit_whole(groups: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows admitted in order within each key's budget, whole or not at all; a later smaller one may still fit.

    Order-dependent, so keys are sorted within their partitions and stream through one pass that carries the budget from row
    to row; no key is held in memory. Rows without a key or size are not admitted."""
    at_key, at_size = groups.columns.index(key), groups.columns.index(size)

    def run(batches):
        last, left = None, budget
        for batch in batches:
            fits = []
            for k, n in zip(batch.column(at_key).to_pylist(), batch.column(at_size).to_pylist()):
                last, left = k, budget if k != last else left
                fits.append(n <= left)
                left -= n if n <= left else 0
            yield batch.filter(pa.array(fits, pa.bool_()))

    some = groups.where(F.col(key).isNotNull() & F.col(size).isNotNull())
    return some.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, groups.schema)


def batches(df: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds pass, the number of the row's batch of so many rows in its group."""
    return df.withColumn("pass", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the last value of right at or before its time, by one sort of both sides."""
    a = left.withColumns({"_v": F.lit(None).cast(dict(right.dtypes)[value]), "_side": F.lit(1)})
    b = right.select(*keys, at, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_v", "_side")


def normal_equations(df: DataFrame, x: list[str], y: str) -> DataFrame:
    """One row of the sums that a plane fit of y on x with a constant needs."""
    names = [*x, y]
    return df.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in names), *(F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for i, a in enumerate(names) for b in names[i:]))


def with_previous(distinct: DataFrame, by: list[str], value: str, span: Column, name: str) -> DataFrame:
    """distinct (by, value) rows with the next smaller value of the same `by`, null for the first.

    Values are ordered within spans (a function of the value that grows with it) and the last of each span is handed on to
    the next, so a key with most of the rows is split; what is ordered in one task is a span, or one key's list of spans."""
    d = distinct.withColumn("_span", span)
    inner = F.lag(value).over(Window.partitionBy(*by, "_span").orderBy(value))
    ends = d.groupBy(*by, "_span").agg(F.max(value).alias("_last"))
    ends = ends.withColumn("_handed", F.lag("_last").over(Window.partitionBy(*by).orderBy("_span"))).drop("_last")
    out = d.withColumn("_inner", inner).join(ends, [*by, "_span"])
    return out.withColumn(name, F.coalesce("_inner", "_handed")).drop("_inner", "_handed", "_span")
