"""First-wins and last-wins selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key.

    ``row_number() = 1`` plans a window group limit below the shuffle, so each map
    task sends at most one row per key and a heavily repeated key stays small.
    """
    ranked = rows.withColumn(
        "_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    )
    return ranked.where("_rank = 1").drop("_rank")


def file_stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def session_index(files: DataFrame, session: Column | None = None) -> DataFrame:
    """Session id (the file stem, or what ``session`` takes from ``file_path``) to its file; the last path wins."""
    ident = file_stem(F.col("file_path")) if session is None else session
    return files.groupBy(ident.alias("session")).agg(F.max("file_path").alias("file_path"))
