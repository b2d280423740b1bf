"""A node of its own for an expression that must not be computed twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, each computed in a node of its own: whatever reads one afterwards, a filter that would move
    below included, never computes it again. Parsed JSON needs this, for expressions are inlined where they are used."""
    for name, column in columns.items():
        rows = rows.select("*", F.explode_outer(F.array(column)).alias(name))
    return rows
