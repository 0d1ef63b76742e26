"""Leakage-safe transition panels and their baselines.

A panel has object_id, current_state, target_state, start_year, target_year and interval_years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SMOOTHING = 0.5


def crosswalk(states: DataFrame, mapping: DataFrame, raw: str, out: str) -> DataFrame:
    """Raw labels to canonical states by normalised key; missing and unknown ones become 'unknown'."""
    key = F.trim(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", " "))
    return (
        states.withColumn("_key", key)
        .join(F.broadcast(mapping.select(F.col("raw").alias("_key"), F.col("state").alias(out))), "_key", "left")
        .withColumn(out, F.coalesce(out, F.lit("unknown")))
        .drop("_key")
    )


def point_in_time(panel: DataFrame, year: str, start: str, out: str) -> DataFrame:
    """Years since an event that lies at or before the start; null and flag 0 for later or missing ones."""
    known = F.col(year) <= F.col(start)
    return panel.withColumns({out: F.when(known, F.col(start) - F.col(year)), f"{out}_known": F.coalesce(known, F.lit(False)).cast("int")})


def assert_no_leakage(panel: DataFrame, years: list[str], start: str = "start_year") -> None:
    """Raises if any row holds a year after its start."""
    bad = panel.where(" or ".join(f"{y} > {start}" for y in years))
    if not bad.isEmpty():
        raise ValueError("the panel holds values from after its start")


def select_interval(panel: DataFrame, start_year: int, target_year: int) -> DataFrame:
    out = panel.where((F.col("start_year") == start_year) & (F.col("target_year") == target_year))
    if out.isEmpty():
        raise ValueError(f"no rows from {start_year} to {target_year}")
    return out


def state_counts(panel: DataFrame, column: str) -> DataFrame:
    return panel.groupBy(F.col(column).alias("state")).agg(F.count("*").alias("n"))


def transition_counts(panel: DataFrame) -> DataFrame:
    """Count and share of all rows of each (current, target); null states are kept."""
    n = panel.groupBy("current_state", "target_state").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("current_state", "target_state", "n", (F.col("n") / F.col("total")).alias("share"))


def interval_summary(panel: DataFrame, raw_current: str, raw_target: str) -> DataFrame:
    """Rows, objects and rates of canonical and raw change by interval."""
    changed = ~F.col("current_state").eqNullSafe(F.col("target_state"))
    raw = ~F.col(raw_current).eqNullSafe(F.col(raw_target))
    return panel.groupBy("start_year", "target_year").agg(
        F.count("*").alias("rows"),
        F.countDistinct("object_id").alias("objects"),
        F.sum(changed.cast("long")).alias("changed"),
        F.avg(changed.cast("int")).alias("change_rate"),
        F.avg(raw.cast("int")).alias("raw_change_rate"),
    )


def transition_matrix(panel: DataFrame, labels: list[str], smoothing: float = SMOOTHING) -> DataFrame:
    """p(target | interval, current), dense over labels: (n + smoothing) over its sum; unseen states become unknown."""
    spark = panel.sparkSession
    dense = spark.createDataFrame([(a, b) for a in labels for b in labels], "current_state string, target_state string")
    lengths = panel.select("interval_years").distinct()
    known = lambda c: F.when(F.col(c).isin(labels), F.col(c)).otherwise("unknown").alias(c)
    n = panel.select("interval_years", known("current_state"), known("target_state")).groupBy("interval_years", "current_state", "target_state").count()
    grid = lengths.crossJoin(F.broadcast(dense)).join(n, ["interval_years", "current_state", "target_state"], "left")
    v = F.coalesce("count", F.lit(0)) + smoothing
    w = Window.partitionBy("interval_years", "current_state")
    return grid.select("interval_years", "current_state", "target_state", (v / F.sum(v).over(w)).alias("p"))


def predict(panel: DataFrame, matrix: DataFrame) -> DataFrame:
    """(object_id, target_year, p): probabilities by state from the matrix of the nearest interval, the shorter on ties."""
    have = matrix.select(F.col("interval_years").alias("fitted")).distinct()
    asked = panel.select("interval_years").distinct()
    order = Window.partitionBy("interval_years").orderBy(F.abs(F.col("fitted") - F.col("interval_years")), "fitted")
    nearest = asked.crossJoin(F.broadcast(have)).withColumn("r", F.row_number().over(order)).where("r = 1").select("interval_years", "fitted")
    rows = matrix.groupBy(F.col("interval_years").alias("fitted"), "current_state").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("target_state", "p")))).alias("p")
    )
    keyed = panel.join(F.broadcast(nearest), "interval_years").join(F.broadcast(rows), ["fitted", "current_state"], "left")
    return keyed.drop("fitted")


def classification_metrics(scored: DataFrame, labels: list[str], target: str = "target_state", p: str = "p") -> DataFrame:
    """One row: accuracy, macro-F1 over all labels (0 where undefined), Brier score and log loss."""
    order = F.array(*map(F.lit, labels))
    probs = F.transform(order, lambda x: F.coalesce(F.element_at(p, x), F.lit(0.0)))
    best = F.element_at(order, F.array_position(F.col("_p"), F.array_max("_p")).cast("int"))
    rows = scored.withColumn("_p", probs).withColumn("_best", best)
    brier = F.aggregate(
        F.zip_with("_p", order, lambda v, x: F.pow(v - (x == F.col(target)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, v: a + v
    )
    loss = -F.log(F.greatest(F.coalesce(F.element_at(p, F.col(target)), F.lit(0.0)), F.lit(1e-12)))
    tp = [F.sum(((F.col("_best") == x) & (F.col(target) == x)).cast("long")) for x in labels]
    seen = [F.sum((F.col("_best") == x).cast("long")) + F.sum((F.col(target) == x).cast("long")) for x in labels]
    f1 = [F.when(s > 0, 2 * t / s).otherwise(0.0) for t, s in zip(tp, seen)]
    return rows.agg(
        F.count("*").alias("n"),
        F.avg((F.col("_best") == F.col(target)).cast("int")).alias("accuracy"),
        (sum(f1[1:], f1[0]) / len(labels)).alias("macro_f1"),
        F.avg(brier).alias("brier"),
        F.avg(loss).alias("log_loss"),
    )


def one_hot(panel: DataFrame) -> DataFrame:
    """The persistence forecast: all probability on the current state."""
    return panel.withColumn("p", F.create_map("current_state", F.lit(1.0)))


def gate(scores: dict[str, dict[str, float]], candidate: str) -> str:
    """The candidate if it beats every other on macro-F1 and on Brier score, else the best other by (-F1, Brier)."""
    others = {n: s for n, s in scores.items() if n != candidate}
    if candidate in scores:
        mine = scores[candidate]
        if mine["macro_f1"] > max(s["macro_f1"] for s in others.values()) and mine["brier"] < min(s["brier"] for s in others.values()):
            return candidate
    return min(others, key=lambda n: (-others[n]["macro_f1"], others[n]["brier"]))


def snapshot(objects: DataFrame, morphology: DataFrame, year: int) -> DataFrame:
    """The present state of objects (object_id, state, area, shape_area, permit_year, completed_year) as of a year.

    Area is the stated one where it is a number from zero up, else that of the shape; years count only where they are not
    after the snapshot's; morphology (object_id, ...) is attached whenever there is one. `sources` names where the area,
    the state and the morphology come from."""
    good = lambda c: F.when((F.col(c) >= 0) & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    seen = lambda c: F.when(F.col(c).between(0, year), F.lit(year) - F.col(c))
    extra = [c for c in morphology.columns if c != "object_id"]
    j = objects.join(morphology.withColumn("_has", F.lit(True)), "object_id", "left")
    has = F.col("_has").isNotNull()
    sources = F.array(
        F.when(good("area").isNotNull(), "area:stated").otherwise("area:shape"), F.when(F.col("state").isNotNull(), "state:table").otherwise("state:unknown"),
        F.when(has, "morphology:points"),
    )
    return j.select(
        "object_id", F.coalesce("state", F.lit("unknown")).alias("state"), F.coalesce(good("area"), F.greatest(F.col("shape_area"), F.lit(0.0))).alias("area"),
        seen("permit_year").isNotNull().alias("permit_known"), seen("completed_year").isNotNull().alias("completion_known"),
        seen("permit_year").alias("years_since_permit"), seen("completed_year").alias("years_since_completion"), has.alias("lidar_available"), *extra,
        F.array_compact(sources).alias("sources"),
    )
