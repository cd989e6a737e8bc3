"""Registered queries of this package over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = ("token_queries", "filter_queries", "dedup_queries", "vector_queries", "chat_queries", "corpus_queries")
MODULES = [importlib.import_module(f"contrail.llm.{name}") for name in NAMES]
Query = Callable[[SparkSession, str], DataFrame]


def _collect(name: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found.update(getattr(module, name))
    return found


def queries() -> dict[str, Query]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
