"""Local maxima of a height grid (row, col, z) with spacing between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityweave.operators.iterate import Rounds, kept
from cityweave.operators.spatial import focal_max, within


def find_peaks(cells: DataFrame, least: float, spacing: float) -> DataFrame:
    """Peaks (row, col, z) at least so high and so far apart, higher ones first, then smaller row and column.

    Candidates are cells as high as their four neighbours; of a flat top the first cell in order stays by the
    spacing rule. In each round the candidates that no better one is near are taken and drop all others near them, which
    ends with what one pass in order would keep, without bringing the grid together."""
    best = focal_max(cells, 1).withColumnRenamed("z", "top")
    c = cells.join(best, ["row", "col"]).where((F.col("z") >= F.col("top")) & (F.col("z") >= least)).select("row", "col", "z")
    c = kept(c.withColumn("id", F.struct((-F.col("z")).alias("h"), "row", "col")))
    return _apart(c, spacing, F.col("dist") < float(spacing)).select("row", "col", "z")


def crown_tops(cells: DataFrame, least: float, spacing: float) -> DataFrame:
    """Peaks (row, col, z) of a canopy model: as high as all within half the spacing (a cell at least), one for each flat top.

    Tops that touch, corners included, are one flat top and stand at the cell nearest their centre, then of smaller row and
    column. Of two closer than the spacing the higher stays, of equal ones the one whose top comes first by row and column.
    Cells without a height, null or NaN, are no canopy and hide no other."""
    cells = cells.where("z is not null and not isnan(z)").select("row", "col", "z")
    best = focal_max(cells, max(spacing / 2, 1.0)).withColumnRenamed("z", "top")
    tops = kept(cells.join(best, ["row", "col"]).where((F.col("z") >= F.col("top")) & (F.col("z") >= least)).select("row", "col", "z"))
    flat = tops.select(F.struct("row", "col").alias("node"), "row", "col", "z").join(_touching(tops), "node", "left")
    flat = kept(flat.withColumn("first", F.coalesce("first", "node")).drop("node"))
    centre = flat.groupBy("first").agg(F.avg("row").alias("r"), F.avg("col").alias("c"))
    gap = (F.col("row") - F.col("r")) ** 2 + (F.col("col") - F.col("c")) ** 2
    one = flat.join(centre, "first").groupBy("first").agg(F.min(F.struct(gap.alias("gap"), "row", "col", "z")).alias("m"))
    one = one.select("m.row", "m.col", "m.z", "first")
    ranked = kept(one.select("row", "col", "z", F.struct((-F.col("z")).alias("h"), "first.row", "first.col").alias("id")))
    return _apart(ranked, spacing, F.col("dist") <= 0.999 * spacing).select("row", "col", "z")


def _touching(tops: DataFrame) -> DataFrame:
    """(node, first) of the tops that touch another: the first cell of their group. Least cells go to neighbours and every
    label jumps to its label's label, so rounds follow the logarithm of a flat top's width."""
    rounds = Rounds()
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    sent = tops.select(F.struct("row", "col").alias("a"), "row", "col", F.explode(F.array(*around)).alias("d"))
    sent = sent.select("a", (F.col("row") + F.col("d.i")).alias("row"), (F.col("col") + F.col("d.j")).alias("col"))
    edges = rounds.keep(sent.join(tops.select("row", "col"), ["row", "col"]).select("a", F.struct("row", "col").alias("b")))
    labels = rounds.keep(edges.select(F.col("a").alias("node"), F.col("a").alias("first")).distinct())
    while True:
        got = edges.join(labels.toDF("b", "got"), "b").groupBy(F.col("a").alias("node")).agg(F.min("got").alias("got"))
        step = rounds.keep(labels.join(got, "node").select("node", F.least("first", "got").alias("first")))
        new = rounds.keep(step.join(step.toDF("first", "next"), "first").select("node", F.col("next").alias("first")))
        if new.join(labels.toDF("node", "old"), "node").where("first <> old").isEmpty():
            return kept(new)
        labels = new
        rounds.tidy(edges, labels)


def _apart(c: DataFrame, spacing: float, close: Column) -> DataFrame:
    """Candidates (id, row, col, z) that no better one, of smaller id, rules out by being close.

    In each round the candidates that no better one is near are taken and drop all others near them."""
    at = c.select("id", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    near = kept(within(at, at, spacing).where(F.col("id") != F.col("other")).where(close).select("id", "other"))
    left, out = c.select("id"), None
    while True:  # the first candidate left is taken in every round
        blocked = near.join(left, "id", "left_semi").join(left.withColumnRenamed("id", "other"), "other", "left_semi").where("other < id").select("id").distinct()
        took = kept(left.join(blocked, "id", "left_anti"))
        if took.isEmpty():
            break
        out = took if out is None else out.unionAll(took)
        hit = near.join(took, "id", "left_semi").select(F.col("other").alias("id")).distinct()
        left = kept(left.join(took, "id", "left_anti").join(hit, "id", "left_anti"))
    out = left if out is None else out
    return c.join(out, "id", "left_semi")
