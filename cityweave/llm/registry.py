"""Queries of the corpus operators and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import importlib

MODULES = (
    "token_store",
    "mixing",
    "line_dedup",
    "warc",
    "suffix_dedup",
    "toxicity",
    "embedding_dedup",
    "simhash",
    "maxscore",
    "bpe",
    "weighted_sampling",
    "whitening",
    "dual_tree",
)


def _modules() -> list:
    return [importlib.import_module(f"cityweave.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {name: f for m in _modules() for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
