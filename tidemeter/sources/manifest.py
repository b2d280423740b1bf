"""Input manifests: which files are new, changed or gone since the last run."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["source", "file_path"]
SIGNATURE = ["source", "file_path", "modified", "bytes"]
#: How a file was read: a parse under other rules, or by another reader version, is another parse.
READ_BY = ["rules", "reader"]


def rules_version(rules: Iterable[tuple[int, str, str]]) -> str:
    """A fingerprint of an alias rule list; order of the list does not matter, order numbers do."""
    return hashlib.sha256(repr(sorted(rules)).encode()).hexdigest()[:16]


def read_by(files: DataFrame, rules: Iterable[tuple[int, str, str]], reader: int) -> DataFrame:
    return files.withColumns({"rules": F.lit(rules_version(rules)), "reader": F.lit(reader)})


def changed(current: DataFrame, previous: DataFrame, signature: Sequence[str] = SIGNATURE) -> DataFrame:
    """Files whose (source, path, time, size) is not in the previous manifest."""
    return current.join(previous.select(*signature), list(signature), "left_anti")


def removed(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Files of the previous manifest that are gone."""
    return previous.join(current.select(*KEYS), KEYS, "left_anti")


def drop_stale(parsed: DataFrame, current: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Parsed rows of files that still exist and are not about to be parsed again."""
    return parsed.join(current.select(*KEYS), KEYS, "left_semi").join(
        refreshed.select(*KEYS), KEYS, "left_anti")


def inventory(files: DataFrame, max_file_bytes: int) -> DataFrame:
    """Per source, number of files, how many pass the size guard, and their volume."""
    return files.groupBy("source").agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("bytes") <= max_file_bytes).alias("readable"),
        F.sum("bytes").alias("bytes"))


def file_days(parsed: DataFrame) -> DataFrame:
    """The days that rows of each file fall on; a calendar bounds the list."""
    return parsed.groupBy(*KEYS).agg(F.array_sort(F.collect_set("day")).alias("days"))


def with_days(current: DataFrame, previous: DataFrame, fresh: DataFrame, parsed: DataFrame) -> DataFrame:
    """The next manifest: days of files parsed now from their rows, of all others from the previous manifest."""
    known = previous.select(*KEYS, "days").join(fresh.select(*KEYS), KEYS, "left_anti").unionByName(file_days(parsed))
    none = F.array().cast("array<date>")
    return current.select(*SIGNATURE, *READ_BY).join(known, KEYS, "left").withColumn("days", F.coalesce("days", none))
