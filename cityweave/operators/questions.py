"""Typed map questions: filters, a metric, a threshold, and rank, count or by-sector answers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.functions.columns import label_key


@dataclass(frozen=True)
class Question:
    kind: str  # rank, count or by_sector
    metric: str
    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    at_least: float | None = None
    descending: bool = True
    limit: int = 10


def issues(q: Question, objects: DataFrame) -> list[str]:
    """What is wrong with a question: unknown kind, metric, filter column or filter value."""
    out = [f"unknown kind {q.kind}"] if q.kind not in ("rank", "count", "by_sector") else []
    if q.metric not in objects.columns:
        out.append(f"unknown metric {q.metric}")
    for column, values in sorted(q.filters.items()):
        if column not in objects.columns:
            out.append(f"unknown column {column}")
            continue
        asked = objects.sparkSession.createDataFrame([(v,) for v in values], "v string").select("v", label_key("v").alias("k"))
        known = objects.select(label_key(column).alias("k")).distinct()
        out += [f"unknown {column} {r.v}" for r in asked.join(known, "k", "left_anti").orderBy("v").collect()]
    return out


def answer(q: Question, objects: DataFrame, key: str = "object_id", sector: str = "sector") -> DataFrame:
    rows = objects
    for column, values in q.filters.items():
        wanted = objects.sparkSession.createDataFrame([(v,) for v in values], "v string").select(label_key("v").alias("_k")).distinct()
        rows = rows.withColumn("_k", label_key(column)).join(F.broadcast(wanted), "_k", "left_semi").drop("_k")
    if q.at_least is not None:
        rows = rows.where(F.col(q.metric) >= q.at_least)
    if q.kind == "count":
        return rows.agg(F.count("*").alias("n"), F.avg(q.metric).alias("mean"))
    if q.kind == "by_sector":
        return rows.groupBy(sector).agg(F.count("*").alias("n"), F.avg(q.metric).alias("mean"))
    order = F.desc(q.metric) if q.descending else F.asc(q.metric)
    return rows.where(F.col(q.metric).isNotNull()).orderBy(order, key).limit(min(25, max(1, q.limit))).select(key, sector, q.metric)
