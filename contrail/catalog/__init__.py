"""Registered queries over the given tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("track", "rules", "zones", "decode", "archive", "streams")
Query = Callable[[SparkSession, str], DataFrame]


def _collect(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(getattr(importlib.import_module(f"contrail.catalog.{module}"), name))
    return found


def queries() -> dict[str, Query]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
