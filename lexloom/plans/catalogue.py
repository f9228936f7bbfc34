"""The reference-operator queries of all plan modules, by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name -> callable) and ORACLES (name -> DuckDB SQL).
MODULES = ("texts", "contamination", "dedup", "tokens", "conversations", "samples", "costs", "markdown", "streams", "sources", "indexes", "snapshots", "checked")


def _modules():
    return [import_module(f"lexloom.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.ORACLES.items()}
