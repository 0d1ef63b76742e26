"""Table functions, a grouped Arrow aggregate and polyline simplification: where Python runs, it runs on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

LINE = "array<struct<x: double, y: double>>"


class LineUnits:
    """line_units(line, n): (k, x1, y1, x2, y2), the line cut into n units of equal length; nothing for lines without length."""

    def eval(self, line: list, n: int) -> Iterator[tuple]:
        if not line or n is None or n < 1:
            return
        at = np.array([(p["x"], p["y"]) for p in line], dtype=float)
        past = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(at, axis=0).T))]) if len(at) > 1 else np.zeros(1)
        if past[-1] == 0:
            return
        d = past[-1] * np.arange(n + 1) / n
        x, y = np.interp(d, past, at[:, 0]), np.interp(d, past, at[:, 1])
        for k in range(n):
            yield k, float(x[k]), float(y[k]), float(x[k + 1]), float(y[k + 1])


class BoxTiles:
    """box_tiles(x1, y1, x2, y2, size): (col, row), all tiles that a box touches; nothing where a bound is null."""

    def eval(self, x1: float, y1: float, x2: float, y2: float, size: float) -> Iterator[tuple]:
        if None in (x1, y1, x2, y2):
            return
        for col in range(int(np.floor(x1 / size)), int(np.floor(x2 / size)) + 1):
            for row in range(int(np.floor(y1 / size)), int(np.floor(y2 / size)) + 1):
                yield col, row


def register(spark: SparkSession) -> None:
    """Make line_units and box_tiles known to SQL."""
    spark.udtf.register("line_units", F.udtf(LineUnits, returnType="k int, x1 double, y1 double, x2 double, y2 double"))
    spark.udtf.register("box_tiles", F.udtf(BoxTiles, returnType="col long, row long"))


@F.pandas_udf(DoubleType())
def trimmed_mean(v: pd.Series) -> float:
    """Mean of a group without its lowest and highest tenth; the group must fit into one task."""
    a = np.sort(v.dropna().to_numpy())
    cut = len(a) // 10
    return float(a[cut : len(a) - cut].mean()) if len(a) else float("nan")


def kept_points(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of a polyline a simplification keeps: the ends, and the farthest of each stretch that strays further
    than the tolerance from its chord."""
    keep = np.zeros(len(x), dtype=bool)
    if len(x) == 0:
        return keep
    keep[[0, -1]] = True
    todo = [(0, len(x) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        dx, dy = x[j] - x[i], y[j] - y[i]
        px, py = x[i + 1 : j] - x[i], y[i + 1 : j] - y[i]
        t = np.clip((px * dx + py * dy) / max(dx * dx + dy * dy, 1e-12), 0, 1)
        gap = np.hypot(px - t * dx, py - t * dy)
        far = int(gap.argmax())
        if gap[far] > tolerance:
            keep[i + 1 + far] = True
            todo += [(i, i + 1 + far), (i + 1 + far, j)]
    return keep


def simplified(tolerance: float):
    """A column function: polylines (arrays of structs x, y) with only the points that the tolerance needs."""

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        def one(line):
            if line is None or len(line) < 3:
                return line
            xs, ys = (np.array([p[k] for p in line], dtype=float) for k in ("x", "y"))
            return [p for p, k in zip(line, kept_points(xs, ys, tolerance)) if k]

        return lines.map(one)

    return run
