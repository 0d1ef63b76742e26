"""Evidence registries: sources (id, effective_from, effective_until, supersedes array, verified) and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def superseded(sources: DataFrame) -> DataFrame:
    """(id, by): sources named by another's supersedes list, each with the smallest id that does."""
    s = sources.select(F.col("id").alias("by"), F.explode("supersedes").alias("id"))
    return s.groupBy("id").agg(F.min("by").alias("by"))


def dangling_references(sources: DataFrame) -> DataFrame:
    """(by, id): supersedes entries that name no source."""
    s = sources.select(F.col("id").alias("by"), F.explode("supersedes").alias("id"))
    return s.join(sources.select("id"), "id", "left_anti").select("by", "id")


def citation_problems(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """citations (source_id, on) with problems, an array that is empty for a sound one."""
    s = sources.join(superseded(sources), "id", "left").withColumnRenamed("id", "source_id").withColumn("_known", F.lit(True))
    j = citations.join(s, "source_id", "left")
    found = F.array(
        F.when(F.col("_known").isNull(), "unknown source"),
        F.when(F.col("on") < F.col("effective_from"), "not yet in force"),
        F.when(F.col("on") > F.col("effective_until"), "expired"),
        F.when(F.col("by").isNotNull(), F.concat(F.lit("superseded by "), "by")),
        F.when(~F.col("verified"), "not verified"),
    )
    return j.select(*citations.columns, F.filter(found, lambda x: x.isNotNull()).alias("problems"))


def compared(observed: DataFrame, simulated: DataFrame, tolerances: DataFrame) -> DataFrame:
    """Observed values (location, metric, unit, start, end, value) against simulated ones of the same interval: pass,
    fail, or blocked where a counterpart, the tolerance or the same unit is missing."""
    keys = ["location", "metric", "start", "end"]
    sim = simulated.select(*keys, F.col("unit").alias("_u"), F.col("value").alias("simulated"))
    j = observed.join(sim, keys, "left").join(F.broadcast(tolerances), "metric", "left")
    status = (
        F.when(F.col("simulated").isNull() | F.col("tolerance").isNull() | (F.col("unit") != F.col("_u")), "blocked")
        .when(F.abs(F.col("simulated") - F.col("value")) <= F.col("tolerance"), "pass").otherwise("fail")
    )
    return j.withColumn("status", status).drop("_u")


def field_issues(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims (entity, field, status, source_ids array) with what breaks the rules: allowed statuses, declared sources,
    a survey behind what is surveyed, and no source behind what is unknown."""
    c = claims.withColumn("_s", F.explode_outer("source_ids"))
    j = c.join(sources.select(F.col("id").alias("_s"), "kind"), "_s", "left")
    g = j.groupBy("entity", "field", "status").agg(
        F.count("_s").alias("n"), F.count_if(F.col("_s").isNotNull() & F.col("kind").isNull()).alias("undeclared"), F.count_if(F.col("kind") == "survey").alias("surveys")
    )
    issue = (
        F.when(~F.col("status").isin("surveyed", "mapped", "estimated", "unknown"), "status not allowed").when(F.col("undeclared") > 0, "source not declared")
        .when((F.col("status") == "surveyed") & (F.col("surveys") == 0), "no survey").when((F.col("status") == "unknown") & (F.col("n") > 0), "unknown with a source")
        .when((F.col("status") != "unknown") & (F.col("n") == 0), "no source")
    )
    return g.withColumn("issue", issue).where("issue is not null").select("entity", "field", "issue")
