"""The usage cube: the one pass over raw records behind most answers.

Its keys are calendar days, hours, sources and model names, so its size follows the
calendar and not the data. A query asks for the keys it needs and no others: with few
keys each map task folds its rows into a handful of groups before anything is shuffled.
Every aggregate buffer is a fixed-width primitive, which keeps the raw pass on hash
aggregation with map-side combine (a struct or string buffer would force a sort of the
raw rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.functions import labels
from tidemeter.functions.volumes import composition, zero
from tidemeter.schema import COUNTERS, PARTS

KEYS = ("day", "hour", "source", "model")
COVERAGE = (
    "valid_ts", "with_project", "with_session", "with_input", "with_output",
    "with_cache_read", "with_cache_write", "with_components",
)


def usage_cube(rec: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Totals of everything additive by any of day, hour, timed, source and model.

    ``hour`` is null for records without a parseable time: they count in day totals and
    stay out of hour answers. ``timed`` tells them apart where the hour itself is not needed.
    """
    named = rec.withColumn("model", labels.model_or_unknown(F.col("model"))).withColumn(
        "source", labels.source_or_unknown(F.col("source"))
    ).withColumn("timed", F.col("hour").isNotNull())
    parts = composition(*[F.col(c) for c in ("source", "total", "input", "output", "cache_read", "cache_write")])
    present = {
        "valid_ts": F.col("ts").isNotNull(),
        "with_project": F.col("project") != "",
        "with_session": F.col("session") != "",
        **{f"with_{c}": F.col(c).isNotNull() for c in COUNTERS if c != "total"},
    }
    everything = present["with_input"]
    for c in ("output", "cache_read", "cache_write"):
        everything = everything & present[f"with_{c}"]
    present["with_components"] = everything
    return named.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        *[F.sum(zero(F.col(c))).alias(c) for c in COUNTERS],
        *[F.sum(parts[p]).alias(p) for p in PARTS],
        *[F.count_if(present[c]).alias(c) for c in COVERAGE],
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def additive(df: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Re-aggregate a cube to coarser keys."""
    default = ["calls", *COUNTERS, *PARTS]
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in columns or default])


def beside(keys: list[str], *frames: DataFrame) -> DataFrame:
    """Put frames of unique keys and different numeric columns side by side.

    A union and one aggregation replace a chain of outer joins on the same keys.
    """
    names = [c for f in frames for c in f.columns if c not in keys]
    stacked = [
        f.select(*keys, *[F.col(c) if c in f.columns else F.lit(None).cast("bigint").alias(c) for c in names])
        for f in frames]
    rows = stacked[0]
    for frame in stacked[1:]:
        rows = rows.unionByName(frame)
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names])


def in_range(df: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Inclusive day range; either bound may be open."""
    if since:
        df = df.where(F.col("day") >= F.lit(since).cast("date"))
    if until:
        df = df.where(F.col("day") <= F.lit(until).cast("date"))
    return df


def from_sources(df: DataFrame, sources: list[str] | None) -> DataFrame:
    return df.where(F.col("source").isin(list(sources))) if sources else df


def with_models(df: DataFrame, models: list[str]) -> DataFrame:
    """Model filter on the long table, before any aggregation recomputes totals."""
    return df.where(F.col("model").isin(list(models)))
