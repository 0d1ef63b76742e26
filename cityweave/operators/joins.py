"""Guarded and ranked joins: unique look-ups, readings on a network, completeness, features around points, crops to a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityweave.operators.spatial import to_segments, within


def attach_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns where the key is there; an error if right holds a key twice."""
    if not right.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return left.join(right, key, "left")


def on_network(readings: DataFrame, ways: DataFrame) -> DataFrame:
    """Readings (way, ...) of the ways (way, cls) of a network, with the way's class."""
    return readings.join(ways.groupBy("way").agg(F.first("cls").alias("cls")), "way")


def completeness(inventory: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """One row: ids of the inventory that no part holds, ids of parts that it does not know, ids that parts hold twice."""
    held = parts.groupBy(key).agg(F.count("*").alias("_n"))
    j = inventory.select(key, F.lit(1).alias("_known")).distinct().join(held, key, "full")
    return j.agg(
        F.count(F.when(F.col("_n").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_known").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("_n") > 1, 1)).alias("repeated"),
    )


def distinct_frames(pages: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each id across pages, from the first page that holds it."""
    rest = [c for c in pages.columns if c != key]
    return pages.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def weighted_around(points: DataFrame, features: DataFrame, weights: dict[str, float], radius: float) -> DataFrame:
    """(id, count of each kind, score): features (id, x, y, kind) within the radius of points, best score first by rank."""
    j = within(points, features, radius).join(features.select(F.col("id").alias("other"), "kind"), "other")
    out = j.groupBy("id").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in weights))
    score = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
    return out.withColumn("score", score)


def roads_around(locations: DataFrame, segments: DataFrame, most: float, k: int) -> DataFrame:
    """(id, segment, dist, rank): the k nearest segment midpoints within `most` of each location, the smaller id on ties."""
    mid = segments.select("id", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    near = within(locations, mid, most).select("id", F.col("other").alias("segment"), "dist")
    r = F.row_number().over(Window.partitionBy("id").orderBy("dist", "segment"))
    return near.withColumn("rank", r).where(F.col("rank") <= k)


def cropped(rows: DataFrame, line: DataFrame, buffer: float) -> DataFrame:
    """Rows (id, x, y) at most `buffer` from a line of segments (id, x1, y1, x2, y2)."""
    return rows.join(to_segments(rows.select("id", "x", "y"), line, buffer).select("id").distinct(), "id", "left_semi")
