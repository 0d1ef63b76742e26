"""Identity, selection, digests, distributions and combinations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityweave.functions.columns import present, unit_hash


def allowed_only(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns; an error names any other."""
    extra = sorted(set(df.columns) - set(allowed))
    if extra:
        raise ValueError(f"columns that may not be read: {extra}")
    return df.select(*allowed)


def resolved_ids(df: DataFrame, preferred: str, fallback: list[str], out: str = "object_id") -> DataFrame:
    """Adds the preferred id where present, else the fallback columns joined by colons."""
    other = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fallback))
    return df.withColumn(out, F.when(present(preferred), F.trim(preferred)).otherwise(other))


def latest_status(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds status and its column name: the first of the columns, latest wave first, that is present."""
    held = [F.when(present(c), F.struct(F.trim(c).alias("status"), F.lit(c).alias("wave"))) for c in columns]
    return df.withColumn("_s", F.coalesce(*held)).withColumns({"status": F.coalesce("_s.status", F.lit("unknown")), "wave": F.col("_s.wave")}).drop("_s")


def distribution(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, least, p05, p25, median, p75, p95, mean and largest of every key."""
    points = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.min(value).alias("least"), *(F.percentile(value, q).alias(n) for n, q in points.items()), F.avg(value).alias("mean"), F.max(value).alias("largest")
    )


def top_and_other(df: DataFrame, by: str, category: str, k: int) -> DataFrame:
    """Counts of each key's k largest categories, ties by name, and 'other' for the rest."""
    n = df.groupBy(by, category).agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), category))
    name = F.when(F.col("_r") <= k, F.col(category)).otherwise("other")
    return n.withColumn("_r", r).groupBy(by, name.alias(category)).agg(F.sum("n").alias("n"))


def class_hours(df: DataFrame, cls: str, hour: str) -> DataFrame:
    """One row per class with a count column for every hour of the day."""
    return df.groupBy(cls).pivot(hour, list(range(24))).count().na.fill(0)


def combinations(options: dict[str, list], budget: int, seed: int, spark) -> DataFrame:
    """Lever settings: the full product where it is within the budget, else the row of first settings, each row with one
    lever changed, and the rows of least hash, up to the budget; no row twice."""
    rows = spark.range(1).select(F.lit(0).alias("_one"))
    total = 1
    for name, values in options.items():
        rows = rows.crossJoin(spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"`{name}` {'double' if isinstance(values[0], float) else 'bigint' if isinstance(values[0], int) else 'string'}, `_{name}` int"))
        total *= len(values)
    changed = sum((F.col(f"_{n}") > 0).cast("int") for n in options)
    if total > budget:
        rows = rows.orderBy(F.least(changed, F.lit(2)), unit_hash(F.lit(seed), *(F.col(f"_{n}") for n in options))).limit(budget)
    return rows.select(*options)


def transitions_between(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Counts of (from, to) over neighbouring rows of every key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.select(F.lag(value).over(w).alias("from"), F.col(value).alias("to")).where("from is not null").groupBy("from", "to").agg(F.count("*").alias("n"))
