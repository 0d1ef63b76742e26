"""KPI aggregates, hash-drawn rollouts, and plan search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.functions.columns import pick, unit_hash
from cityweave.operators.iterate import kept


def kpis(objects: DataFrame, by: list[str], built: tuple[str, ...] = ("complete",)) -> DataFrame:
    """Counts, floor area, exact height quantiles and built share of objects (state, area, floors, height); 0 if empty."""
    is_built = F.col("state").isin(*built)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return objects.groupBy(*by).agg(
        F.count("*").alias("objects"),
        F.count_if(is_built).alias("built"),
        F.count_if(F.col("state") == "unknown").alias("unknown"),
        zero(F.sum(F.when(is_built, F.col("area") * F.col("floors")))).alias("floor_area"),
        zero(F.percentile(F.when(is_built, F.col("height")), 0.5)).alias("height_p50"),
        zero(F.percentile(F.when(is_built, F.col("height")), 0.9)).alias("height_p90"),
        zero(F.sum(F.when(is_built, F.col("area"))) / F.sum("area")).alias("built_fraction"),
    )


def ood_score(objects: DataFrame) -> DataFrame:
    """0.6 of the unknown share and 0.4 of the share without floors and height, from 0 to 1."""
    bare = (F.col("floors").isNull() & F.col("height").isNull()).cast("int")
    score = 0.6 * F.avg((F.col("state") == "unknown").cast("int")) + 0.4 * F.avg(bare)
    return objects.agg(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def rollout(objects: DataFrame, matrix: DataFrame, labels: list[str], steps: int, draws: int, seed: int = 7, levers: DataFrame | None = None) -> DataFrame:
    """(draw, step, object_id, state, ...): every object's state after each step of each draw.

    Draws are hashes of (seed, step, draw, object), so the same ones come out in any partitioning and for every
    scenario. levers: (object_id, step, target_state, delta) add to a state's log-odds before the draw."""
    order = F.array(*map(F.lit, labels))
    rows = matrix.groupBy("current_state").agg(F.map_from_entries(F.collect_list(F.struct("target_state", "p"))).alias("m"))
    rows = rows.select(F.col("current_state").alias("state"), F.transform(order, lambda x: F.coalesce(F.element_at("m", x), F.lit(0.0))).alias("p"))
    now = objects.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    out = None
    for step in range(1, steps + 1):
        now = now.join(F.broadcast(rows), "state", "left")
        p = F.col("p")
        if levers is not None:
            mine = levers.where(F.col("step") == step).select("object_id", "target_state", "delta")
            now = now.join(mine, "object_id", "left")
            push = F.when(F.col("target_state").isNotNull(), F.exp("delta")).otherwise(1.0)
            moved = F.transform(p, lambda v, i: F.greatest(v, F.lit(1e-12)) * F.when(F.element_at(order, i + 1) == F.col("target_state"), push).otherwise(1.0))
            now = now.withColumn("_q", F.coalesce(moved, p))
            kept = F.aggregate("_q", F.lit(0.0), lambda a, v: a + v)
            now = now.withColumn("p", F.transform("_q", lambda v: v / kept)).drop("_q", "target_state", "delta")
        u = unit_hash(F.lit(seed), F.lit(step), F.col("draw"), F.col("object_id"))
        now = now.withColumn("state", F.coalesce(F.element_at(order, pick(F.col("p"), u) + 1), F.col("state"))).drop("p")
        part = now.withColumn("step", F.lit(step))
        out = part if out is None else out.unionByName(part)
    return out


def paired_rollout(
    objects: DataFrame, matrix: DataFrame, labels: list[str], steps: int, draws: int, levers: DataFrame,
    seed: int = 7, drawn: Callable[..., Column] = unit_hash,
) -> DataFrame:
    """(draw, step, object_id, state, usual): every object's state with the levers and without, after each step of each draw.

    Both are carried in one row and read the same draw, so they differ only where a lever, or what followed from it, makes
    them differ. levers: (object_id, step, target_state, delta), one a step and object."""
    order = F.array(*map(F.lit, labels))
    rows = matrix.groupBy("current_state").agg(F.map_from_entries(F.collect_list(F.struct("target_state", "p"))).alias("m"))
    chances = F.transform(order, lambda x: F.coalesce(F.element_at("m", x), F.lit(0.0)))
    rows = rows.select(F.col("current_state").alias("state"), chances.alias("p"))  # a row for each label
    now = objects.select("object_id", "state", F.col("state").alias("usual"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    out = None
    for step in range(1, steps + 1):
        mine = levers.where(F.col("step") == step).select("object_id", F.col("target_state").alias("_to"), F.exp("delta").alias("_by"))
        now = now.join(F.broadcast(rows), "state", "left").join(F.broadcast(rows.toDF("usual", "q")), "usual", "left").join(mine, "object_id", "left")
        raised = F.transform("p", lambda v, i: F.greatest(v, F.lit(1e-12)) * F.when(F.element_at(order, i + 1) == F.col("_to"), F.col("_by")).otherwise(1.0))
        now = now.withColumn("_r", raised).withColumn("_s", F.aggregate("_r", F.lit(0.0), lambda a, v: a + v))
        pushed = F.when(F.col("_to").isNull(), F.col("p")).otherwise(F.transform("_r", lambda v: v / F.col("_s")))
        u = drawn(F.lit(seed), F.lit(step), F.col("draw"), F.col("object_id"))
        after = lambda p, old: F.coalesce(F.element_at(order, pick(p, F.col("_u")) + 1), F.col(old)).alias(old)
        now = now.withColumns({"p": pushed, "_u": u}).select("object_id", "draw", after(F.col("p"), "state"), after(F.col("q"), "usual"))
        part = now.withColumn("step", F.lit(step))
        out = part if out is None else out.unionByName(part)
    return out.select("draw", "step", "object_id", "state", "usual")


def paired_bands(pairs: DataFrame, by: list[str], values: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, kpi, p05, p50, p95, usual_p50, higher) of the differences over draws: each value is an aggregate of a column of
    states, taken for both; `higher` is the share of draws in which the levers raise it."""
    both = [f(F.col(c)).cast("double").alias(f"{n}_{c}") for n, f in values.items() for c in ("state", "usual")]
    per = pairs.groupBy(*by, "draw").agg(*both)
    one = lambda n: F.struct(F.lit(n).alias("kpi"), (F.col(f"{n}_state") - F.col(f"{n}_usual")).alias("d"), F.col(f"{n}_usual").alias("u"))
    long = per.select(*by, F.explode(F.array(*map(one, values))).alias("v")).select(*by, "v.*")
    bands_of = [F.percentile("d", q).alias(p) for p, q in (("p05", 0.05), ("p50", 0.5), ("p95", 0.95))]
    return long.groupBy(*by, "kpi").agg(*bands_of, F.percentile("u", 0.5).alias("usual_p50"), F.avg((F.col("d") > 0).cast("int")).alias("higher"))


def bands(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """p05, p50 and p95 over draws."""
    return values.groupBy(*by).agg(*(F.percentile(value, q).alias(n) for q, n in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95"))))


#: Goal vectors that one task compares among themselves.
FRONT_AT_ONCE = 20_000


def _undominated(v: np.ndarray) -> np.ndarray:
    """The rows of v that no other row equals or betters throughout and betters once; a better row has a smaller sum."""
    v = v[np.argsort(v.sum(axis=1), kind="stable")]
    front = v[:0]
    for start in range(0, len(v), 256):
        some = v[start : start + 256]
        for other in (front, some):
            some = some[~((other[None] <= some[:, None]).all(axis=2) & (other[None] < some[:, None]).any(axis=2)).any(axis=1)]
        front = np.concatenate([front, some])
    return front


def _local_fronts(vectors: DataFrame, at_once: int) -> DataFrame:
    """vectors without those that another of their partition beats, met in runs of about `at_once`."""
    names = vectors.columns

    def fronts(batches):
        front = np.empty((0, len(names)))
        for batch in batches:
            front = _undominated(np.concatenate([front, batch[names].to_numpy(dtype=float)]))
            if len(front) > at_once:
                yield pd.DataFrame(front, columns=names)
                front = front[:0]
        yield pd.DataFrame(front, columns=names)

    return vectors.mapInPandas(fronts, vectors.schema)


def pareto(plans: DataFrame, key: str, goals: list[str], at_once: int = FRONT_AT_ONCE) -> DataFrame:
    """Plans that no other plan equals or betters in every goal (smaller is better) and betters in one; plans with a null goal
    compare with none and stay.

    Only what nothing in its own partition beats goes on. If that fits one task it is compared there. Otherwise it is cut into
    blocks along the first goal, and a vector meets the blocks alone whose least goals do not rule them out."""
    known = F.lit(True)
    for g in goals:
        known &= F.col(g).isNotNull()
    names = [f"_g{i}" for i in range(len(goals))]
    vectors = plans.where(known).select(*(F.col(g).cast("double").alias(n) for g, n in zip(goals, names))).distinct()
    left = kept(_local_fronts(vectors, at_once))
    n = left.count()
    if n <= at_once:
        front = _local_fronts(left.coalesce(1), at_once)
    else:
        left = kept(left.repartitionByRange(-(-n // at_once), names[0]).withColumn("_b", F.spark_partition_id()))
        ends = left.groupBy("_b").agg(*(F.min(g).alias(f"_m{g}") for g in names))  # a row for each block
        may = F.lit(True)
        for g in names:
            may &= F.col(f"_m{g}") <= F.col(g)
        sent = left.drop("_b").join(F.broadcast(ends), may).select(*names, "_b")
        other = left.select("_b", *(F.col(g).alias(f"_o{g}") for g in names))
        no_worse, better = F.lit(True), F.lit(False)
        for g in names:
            no_worse &= F.col(f"_o{g}") <= F.col(g)
            better |= F.col(f"_o{g}") < F.col(g)
        beaten = sent.alias("s").join(other.alias("o"), (F.col("s._b") == F.col("o._b")) & no_worse & better, "left_semi")
        front = left.drop("_b").join(beaten.select(*names).distinct(), names, "left_anti")
    front = front.toDF(*names)
    same = [F.col(g).cast("double") == F.col(n) for g, n in zip(goals, names)]
    return plans.where(known).join(front, same, "left_semi").unionByName(plans.where(~known))


def backcast(plans: DataFrame, size: int = 5) -> DataFrame:
    """Feasible plans by intensity and id, then the others by shortfall and intensity; the first `size`."""
    return plans.orderBy(F.desc("feasible"), F.when(~F.col("feasible"), F.col("shortfall")), "intensity", "id").limit(size)
