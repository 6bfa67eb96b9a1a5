"""Registry of the reference-operator queries and their DuckDB oracles."""
from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: put a (spark, sf_dir) query, and its oracle SQL if any, in the catalogue."""

    def keep(function):
        _QUERIES[name] = function
        if oracle is not None:
            _ORACLES[name] = oracle
        return function

    return keep


_MODULES = ["joins_q", "aggs_q", "windows_q", "functions_q", "domain_q", "stages_q", "merges_q", "sources_q", "search_q", "streaming_q"]


def _load() -> None:
    """Query modules register themselves when imported."""
    for name in _MODULES:
        importlib.import_module(f"waymesh.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
