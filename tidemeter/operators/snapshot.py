"""Content fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.functions import calendar as cal
from tidemeter.operators.cube import additive
from tidemeter.schema import COUNTERS


def day_digests(cube: DataFrame) -> DataFrame:
    """(day, digest) of the aggregated content of each day; row order never matters."""
    fields = ["calls", *COUNTERS]
    rows = additive(cube, ["day", "model", "source"], fields)
    digest = F.sha2(F.concat_ws("|", "model", "source", *fields), 256)
    return rows.groupBy("day").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(digest)), ""), 256).alias("digest"))


def snapshot_id(cube: DataFrame) -> DataFrame:
    """24 hex digits that depend on the aggregated content only.

    Rows are hashed, sorted and hashed per day, and the day digests again, so row order
    never matters and every list is bounded by models x sources or by days.
    """
    days = day_digests(cube)
    lines = F.concat_ws("=", cal.iso(F.col("day")), F.col("digest"))
    return days.agg(
        F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(lines)), ";"), 256), 1, 24).alias("snapshot_id"),
        cal.iso(F.min("day")).alias("first_day"), cal.iso(F.max("day")).alias("last_day"))
