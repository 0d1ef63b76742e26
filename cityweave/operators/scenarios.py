"""What rollouts are for: changes against business as usual, candidate plans, lever checks; and rows kept, joined and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Storey height, fallback height, bounds of a recorded height, most floors.
STOREY, FALLBACK, MOST_HEIGHT, MOST_FLOORS = 3.0, 6.0, 300.0, 100


def changes(scenario: DataFrame, usual: DataFrame) -> DataFrame:
    """(year_offset, kpi, p50, usual, median_change) of two band tables (year_offset, kpi, p50)."""
    base = usual.select("year_offset", "kpi", F.col("p50").alias("usual"))
    return scenario.join(base, ["year_offset", "kpi"], "left").select("year_offset", "kpi", "p50", "usual", (F.col("p50") - F.col("usual")).alias("median_change"))


def lever_issues(levers: DataFrame, objects: DataFrame, steps: int, most: float = 3.0) -> DataFrame:
    """(lever, rule) for levers (lever, delta, step, object_ids): repeated names, shifts of nothing or out of range, steps
    beyond the horizon, objects that are not known."""
    rules = F.array(
        F.when(F.col("delta").isNull() | (F.abs("delta") > most) | (F.col("delta") == 0), "delta"),
        F.when(F.col("step").isNull() | (F.col("step") < 0) | (F.col("step") >= steps), "step"),
    )
    own = levers.select("lever", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("rule"))
    twice = levers.groupBy("lever").agg(F.count("*").alias("n")).where("n > 1").select("lever", F.lit("repeated").alias("rule"))
    asked = levers.select("lever", F.explode("object_ids").alias("object_id"))
    unknown = asked.join(objects.select("object_id"), "object_id", "left_anti").select("lever", F.lit("object").alias("rule"))
    return own.unionAll(twice).unionAll(unknown).distinct()


def evaluated(settings: DataFrame, values: DataFrame, targets: DataFrame) -> DataFrame:
    """(candidate, intensity, feasible, least_margin) from settings (candidate, delta, scope), values (candidate, kpi,
    year_offset, value) and targets (kpi, year_offset, op, target); a candidate without settings has intensity 0."""
    intensity = settings.groupBy("candidate").agg(F.bround(F.sum(F.abs("delta") * F.col("scope")), 6).alias("intensity"))
    margin = F.when(F.col("op") == ">=", F.col("value") - F.col("target")).otherwise(F.col("target") - F.col("value"))
    m = values.join(F.broadcast(targets), ["kpi", "year_offset"]).groupBy("candidate").agg(F.min(margin).alias("least_margin"))
    out = m.join(intensity, "candidate", "left")
    return out.select("candidate", F.coalesce("intensity", F.lit(0.0)).alias("intensity"), (F.col("least_margin") >= 0).alias("feasible"), "least_margin")


def resolved_height(recorded: Column, floors: Column, bin_median: Column) -> tuple[Column, Column]:
    """Height and its kind by priority: recorded, by floors, median of the size bin, fallback."""
    rec = F.when((recorded > 0) & (recorded <= MOST_HEIGHT), recorded.cast("double"))
    fl = F.when((floors > 0.99) & (floors <= MOST_FLOORS), floors * STOREY)
    kind = F.when(rec.isNotNull(), "recorded").when(fl.isNotNull(), "floors").when(bin_median.isNotNull(), "size_bin").otherwise("fallback")
    return F.coalesce(rec, fl, bin_median, F.lit(FALLBACK)), kind


def without_known(new: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """known and the new rows whose key it does not hold."""
    return known.unionByName(new.join(known.select(key).distinct(), key, "left_anti").select(known.columns))


def companion_heights(own: DataFrame, companion: DataFrame) -> DataFrame:
    """own (id, height, kind) where the companion's height (id, height) takes the place of fallbacks alone."""
    c = companion.select("id", F.col("height").alias("_h"))
    swap = (F.col("kind") == "fallback") & F.col("_h").isNotNull()
    j = own.join(c, "id", "left")
    return j.select("id", F.when(swap, F.col("_h")).otherwise(F.col("height")).alias("height"), F.when(swap, "companion").otherwise(F.col("kind")).alias("kind"))


def overlapping(left: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows (x1, y1, x2, y2) whose finite, ordered box meets the given one."""
    a, b, c, d = box
    return left.where((F.col("x1") <= F.col("x2")) & (F.col("y1") <= F.col("y2")) & (F.col("x1") <= c) & (F.col("x2") >= a) & (F.col("y1") <= d) & (F.col("y2") >= b))


def bounds_issue(names: tuple[str, ...]) -> Column:
    """The first fault of a box's bounds: missing, not finite, not ordered; null where there is none."""
    x1, y1, x2, y2 = (F.col(n) for n in names)
    every = F.array(x1, y1, x2, y2)
    bad = F.exists(every, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.exists(every, lambda v: v.isNull()), "missing").when(bad, "not_finite").when((x1 > x2) | (y1 > y2), "not_ordered")


def reviewed(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """pairs (photo, building) with a status and reason by decisions (photo, building, keep, reason); a decision on the pair
    goes before one on the photo (building null)."""
    on_pair = decisions.where("building is not null").select("photo", "building", F.col("keep").alias("k1"), F.col("reason").alias("r1"))
    on_photo = decisions.where("building is null").select("photo", F.col("keep").alias("k2"), F.col("reason").alias("r2"))
    j = pairs.join(on_pair, ["photo", "building"], "left").join(on_photo, "photo", "left")
    keep = F.coalesce("k1", "k2")
    status = F.when(keep.isNull(), "retained").when(keep, "kept").otherwise("excluded")
    return j.select("photo", "building", status.alias("status"), F.when(status == "excluded", F.coalesce("r1", "r2")).alias("reason"))


def gap_counts(objects: DataFrame, evidence: DataFrame) -> DataFrame:
    """(reason, n) of objects (id) with evidence (id, quality): without any, poor only, or covered."""
    best = evidence.groupBy("id").agg(F.max("quality").alias("best"))
    reason = F.when(F.col("best").isNull(), "none").when(F.col("best") < 1, "poor").otherwise("covered")
    return objects.join(best, "id", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def nearest_to(df: DataFrame, x: float, y: float, most: int) -> DataFrame:
    """The rows (id, x, y) nearest to a focus, the smaller id on ties."""
    d = F.sqrt((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2)
    return df.withColumn("dist", d).orderBy("dist", "id").limit(most)


def inside_share(objects: DataFrame, network: DataFrame, margin: float = 0.0) -> DataFrame:
    """One row: the network's extent with a margin and the share of objects (x, y) in it."""
    box = network.agg(*(f(c).alias(f"{c}{n}") for c in ("x", "y") for n, f in ((1, F.min), (2, F.max))))
    box = box.select(*((F.col(f"{c}{n}") + (margin if n == 2 else -margin)).alias(f"{c}{n}") for c in ("x", "y") for n in (1, 2)))
    held = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    return objects.crossJoin(F.broadcast(box)).groupBy("x1", "x2", "y1", "y2").agg(F.avg(held.cast("int")).alias("share"))  # box is one row
