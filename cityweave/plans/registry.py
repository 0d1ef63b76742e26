"""All registered queries of the city-data operators, and their DuckDB counterparts."""

from __future__ import annotations

import importlib
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Modules of this folder that hold QUERIES and ORACLES.
MODULES = ("speeds", "panel", "audit", "spatial", "ledger", "network", "forecast", "more", "basics", "layers", "roads", "people", "grids", "scenarios", "joins", "elements", "lines", "learned", "views", "placing", "canopy")


@cache
def _modules() -> tuple:
    return tuple(importlib.import_module(f"cityweave.plans.{name}") for name in MODULES)


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cityweave.plans import speeds

    return speeds.holdout_scores(spark, sf_dir, roads=4, min_count=2)
