"""Collects every registered query and its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = [
    "contact_centre",
    "records",
    "flows",
    "behaviour",
    "bookings",
    "operations",
    "digital",
    "consent",
    "commercial",
    "dashboard",
    "quality",
    "engagement",
    "debt",
    "dataflows",
    "metering",
]


def _load():
    qs: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}
    for name in _MODULES:
        mod = import_module(f"{__package__}.{name}")
        for key in mod.QUERIES:
            if key in qs:
                raise ValueError(f"duplicate query name {key}")
        qs.update(mod.QUERIES)
        sql.update(getattr(mod, "ORACLE", {}))
    return qs, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _load()[0]


def oracle_sql() -> dict[str, str]:
    return _load()[1]
