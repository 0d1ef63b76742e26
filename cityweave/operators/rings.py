"""Rings of multipolygon relations from their member lines. A relation's members are a bounded group by nature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Ring = list[tuple[float, float]]


def closed_rings(parts: list[Ring]) -> list[Ring] | None:
    """Closed rings that use every part once; None where an end has no part or more than one to go on with, or a ring has
    fewer than four points."""
    at: dict[tuple[float, float], set[int]] = {}
    for i, p in enumerate(parts):
        for end in (p[0], p[-1]):
            at.setdefault(end, set()).add(i)
    free, rings = dict.fromkeys(range(len(parts))), []
    while free:
        start = next(iter(free))
        del free[start]
        ring = list(parts[start])
        while ring[0] != ring[-1]:
            onward = [i for i in at[ring[-1]] if i in free]
            if len(onward) != 1 or parts[onward[0]][0] == parts[onward[0]][-1]:
                return None
            piece = parts[onward[0]]
            del free[onward[0]]
            ring += (piece if piece[0] == ring[-1] else piece[::-1])[1:]
        if len(ring) < 4:
            return None
        rings.append(ring)
    return rings


def _area(ring: Ring) -> float:
    x, y = np.array(ring).T
    return abs(float(x[:-1] @ y[1:] - x[1:] @ y[:-1])) / 2


def _inside(point: tuple[float, float], ring: Ring) -> bool:
    x, y = np.array(ring).T
    over = (y[:-1] > point[1]) != (y[1:] > point[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = x[:-1] + (point[1] - y[:-1]) * (x[1:] - x[:-1]) / (y[1:] - y[:-1])
    return bool((over & (point[0] < cut)).sum() % 2)


def multipolygons(members: DataFrame) -> DataFrame:
    """(relation, polygon, hole, ring) from members (relation, seq, role, points: array of structs x, y).

    A null or empty role is outer; other roles than outer and inner don't count. Each hole belongs to the smallest outer
    ring around its first point. A relation with a member without points, without an outer ring, with lines that don't close
    in one way only, or with a hole outside gives no rows."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        relation, out = group["relation"].iloc[0], []
        parts: dict[str, list[Ring]] = {"outer": [], "inner": []}
        whole = True
        for role, points in group.sort_values("seq")[["role", "points"]].itertuples(index=False):
            role = role or "outer"
            if role in parts:
                whole = whole and points is not None and len(points) > 0
                parts[role].append([(p["x"], p["y"]) for p in points] if points is not None else [])
        outer = closed_rings(parts["outer"]) if whole else None
        holes = closed_rings(parts["inner"]) if whole else None
        if outer and holes is not None:
            out = [(relation, i, False, r) for i, r in enumerate(outer)]
            for h in holes:
                around = [i for i, r in enumerate(outer) if _inside(h[0], r)]
                if not around:
                    out = []
                    break
                out.append((relation, min(around, key=lambda i: _area(outer[i])), True, h))
        rows = [(a, b, c, [{"x": x, "y": y} for x, y in r]) for a, b, c, r in out]
        return pd.DataFrame(rows, columns=["relation", "polygon", "hole", "ring"])

    kind = dict(members.dtypes)["relation"]
    return members.select("relation", "seq", "role", "points").groupBy("relation").applyInPandas(
        one, f"relation {kind}, polygon int, hole boolean, ring array<struct<x: double, y: double>>")
