"""All queries of the core library, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandwise.plans import catalogue, comparisons, core, ledger, reports, screening, textual

_MODULES = (catalogue, core, textual, reports, screening, ledger, comparisons)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
