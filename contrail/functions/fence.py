"""Costly columns that are computed once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """Add (or replace) columns so that later filters and columns reuse their values.

    A plain projection can be dissolved by the optimizer: a filter on a computed column is
    pushed below it and takes a copy of the expression along, and columns built on columns
    multiply. Going through a one-row generator keeps the values; it stays in generated code
    and shuffles nothing.
    """
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    return df.select(*[c for c in df.columns if c not in cols], F.inline(F.array(row)))
