"""Placing one layer on another: polynomial displacement fits by re-weighted normal equations, pairing and fitting in turn, and
whether a local field would help."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.operators.iterate import kept
from cityweave.operators.matching import one_to_one
from cityweave.operators.spatial import within

#: Tuning of the Huber weights, and the unit of the polynomial's coordinates.
HUBER, NORMAL_MAD, FLOOR, UNIT = 1.345, 1.4826, 0.5, 1000.0


class Displacement:
    """dx and dy as polynomials of order 0 (shift), 1 (affine) or 2 (quadratic) around a centre."""

    def __init__(self, order: int, centre: tuple[float, float], coefficients: np.ndarray):
        self.order, self.centre, self.coefficients = order, centre, coefficients

    def basis(self, x: Column, y: Column) -> list[Column]:
        a, b = (x - self.centre[0]) / UNIT, (y - self.centre[1]) / UNIT
        return [F.lit(1.0), *([a, b] if self.order else []), *([a * a, a * b, b * b] if self.order > 1 else [])]

    def moved(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Where the points go."""
        total = lambda k: sum((float(c) * f for c, f in zip(self.coefficients[:, k], self.basis(x, y))), F.lit(0.0))
        return x + total(0), y + total(1)


def displacement_fit(pairs: DataFrame, order: int, centre: tuple[float, float] | None = None, rounds: int = 25, floor: float = FLOOR) -> Displacement:
    """The displacement that takes (x, y) to (u, v) of pairs, with Huber weights.

    Each round takes the weights' scale from two medians over all rows (approximate, to a 10,000th of the rows) and adds
    up the weighted normal equations in one aggregate; the driver solves a system of 1, 3 or 6 unknowns."""
    if centre is None:
        centre = tuple(pairs.agg(*(F.percentile_approx(c, 0.5, 10_000) for c in "xy")).first())
    n = (1, 3, 6)[order]
    fit, weight = Displacement(order, centre, np.zeros((n, 2))), F.lit(1.0)
    for r in range(rounds):
        if r:
            mx, my = fit.moved(F.col("x"), F.col("y"))
            rest = pairs.withColumn("_r", F.sqrt((mx - F.col("u")) ** 2 + (my - F.col("v")) ** 2))
            middle = rest.agg(F.percentile_approx("_r", 0.5, 10_000)).first()[0]
            spread = rest.agg(F.percentile_approx(F.abs(F.col("_r") - middle), 0.5, 10_000)).first()[0]
            k = max(HUBER * NORMAL_MAD * spread, floor)
            weight = F.when(F.col("_r") <= k, 1.0).otherwise(k / F.greatest("_r", F.lit(1e-12)))
        else:
            rest = pairs
        f = fit.basis(F.col("x"), F.col("y"))
        sums = {f"a{i}_{j}": weight * f[i] * f[j] for i in range(n) for j in range(i, n)}
        sums |= {f"b{i}_{k}": weight * f[i] * d for i in range(n) for k, d in enumerate((F.col("u") - F.col("x"), F.col("v") - F.col("y")))}
        s = rest.agg(*(F.sum(e).alias(c) for c, e in sums.items())).first()
        left = np.array([[s[f"a{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        after = np.linalg.lstsq(left, np.array([[s[f"b{i}_{k}"] for k in (0, 1)] for i in range(n)]), rcond=None)[0]
        settled = np.abs(after - fit.coefficients).max() < 1e-7
        fit = Displacement(order, centre, after)
        if settled:
            break
    return fit


def box_overlaps(placed: DataFrame, reference: DataFrame, reach: float, least: float) -> DataFrame:
    """(a, b, score): pairs of boxes (id, x, y, w, h) around their centres, at most `reach` apart, by their area in common over
    that of both together, from `least` up."""
    near = within(placed, reference, reach).select(F.col("id").alias("a"), F.col("other").alias("b"))
    named = lambda df, p: df.select(F.col("id").alias(p), *(F.col(c).alias(f"{p}{c}") for c in "xywh"))
    j = near.join(named(placed, "a"), "a").join(named(reference, "b"), "b")
    side = lambda c, s: F.greatest(F.lit(0.0), F.least(F.col(f"a{c}") + F.col(f"a{s}") / 2, F.col(f"b{c}") + F.col(f"b{s}") / 2) - F.greatest(F.col(f"a{c}") - F.col(f"a{s}") / 2, F.col(f"b{c}") - F.col(f"b{s}") / 2))
    both = side("x", "w") * side("y", "h")
    j = j.withColumn("score", both / (F.col("aw") * F.col("ah") + F.col("bw") * F.col("bh") - both))
    return j.where(F.col("score") >= least).select("a", "b", "score")


def alternating_fit(placed: DataFrame, reference: DataFrame, order: int, reach: float, least: float, rounds: int = 5) -> tuple[Displacement, DataFrame]:
    """A displacement of boxes onto reference boxes by pairing and fitting in turn, and the last pairs (a, b, score).

    Boxes are paired one to one as they stand, the fit is made from where they stood at first, they move, and pair again:
    pairing them unmoved alone would favour those that already overlap. Ends when no pair changes."""
    centre = tuple(placed.agg(*(F.percentile_approx(c, 0.5, 10_000) for c in "xy")).first())
    own = placed.select(F.col("id").alias("a"), "x", "y")
    target = reference.select(F.col("id").alias("b"), F.col("x").alias("u"), F.col("y").alias("v"))
    fit, before, now = Displacement(0, centre, np.zeros((1, 2))), None, placed
    for _ in range(rounds):
        pairs = kept(one_to_one(box_overlaps(now, reference, reach, least)))
        if before is not None and pairs.select("a", "b").exceptAll(before.select("a", "b")).isEmpty() and pairs.count() == before.count():
            break
        before = pairs
        fit = displacement_fit(kept(pairs.join(own, "a").join(target, "b")), order, centre)
        x, y = fit.moved(F.col("x"), F.col("y"))
        now = placed.select("id", x.alias("x"), y.alias("y"), "w", "h")
    return fit, before


def local_field(pairs: DataFrame, bandwidth: float, reach: float) -> DataFrame:
    """(id, fold, weight, plain, local): for pairs (id, x, y, dx, dy, fold) the error left by the mean shift of the other folds,
    and by it and a local field: the mean of what it leaves of the other folds' pairs within reach, weighted by a Gaussian
    of their distance and drawn toward nothing where they are few or far (sum of weights over itself and one)."""
    sums = pairs.groupBy("fold").agg(F.count("*").alias("n"), F.sum("dx").alias("sx"), F.sum("dy").alias("sy"))  # a row for each fold
    whole = sums.agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")).first()
    others = F.nullif(F.lit(whole.n) - F.col("n"), F.lit(0))
    shift = sums.select("fold", (F.lit(whole.sx) - F.col("sx")).alias("x"), (F.lit(whole.sy) - F.col("sy")).alias("y"), others.alias("n"))
    shift = shift.select("fold", F.coalesce(F.col("x") / F.col("n"), F.lit(0.0)).alias("mx"), F.coalesce(F.col("y") / F.col("n"), F.lit(0.0)).alias("my"))
    own = pairs.select("id", "fold")
    near = within(pairs, pairs, reach).join(own, "id").join(pairs.select(F.col("id").alias("other"), F.col("fold").alias("_f"), "dx", "dy"), "other").where("fold <> _f")
    w = F.exp(-0.5 * (F.col("dist") / bandwidth) ** 2)
    field = near.groupBy("id").agg(F.sum(w).alias("weight"), F.sum(w * F.col("dx")).alias("wx"), F.sum(w * F.col("dy")).alias("wy"))
    j = pairs.join(F.broadcast(shift), "fold").join(field, "id", "left").fillna(0.0, ["weight", "wx", "wy"])
    ex, ey = F.col("dx") - F.col("mx"), F.col("dy") - F.col("my")
    more = lambda s, m: (F.col(s) - F.col(m) * F.col("weight")) / (F.col("weight") + 1)
    size = lambda a, b: F.sqrt(a * a + b * b)
    return j.select("id", "fold", "weight", size(ex, ey).alias("plain"), size(ex - more("wx", "mx"), ey - more("wy", "my")).alias("local"))
