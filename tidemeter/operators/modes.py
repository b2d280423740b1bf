"""Rule-based description of each day's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.functions.volumes import share
from tidemeter.operators.cube import additive, beside
from tidemeter.operators.rhythm import hour_vector, hourly

# The classification thresholds.
MINIMUM_VOLUME = 1000
CACHE_RATIO = 0.35
EXPLORE_MODELS, EXPLORE_PROJECTS = 3, 4
DEEP_HOURS, DEEP_SHARE = 6, 0.72
SPRINT_MULTIPLE = 1.8


def best_four_hours(hours: Column) -> Column:
    """Largest sum of four neighbouring hours, midnight wrapping around."""
    circle = F.concat(hours, F.slice(hours, 1, 3))
    return F.array_max(F.transform(
        F.sequence(F.lit(1), F.lit(24)),
        lambda i: F.aggregate(F.slice(circle, i, 4), F.lit(0).cast("bigint"), lambda a, x: a + x)))


def daily_features(cube: DataFrame, projects: DataFrame) -> DataFrame:
    """Per day: totals, cache ratio, variety and concentration. Inputs are already filtered."""
    days = additive(cube, ["day"], ["total", "calls", "cache_read"])
    models = additive(cube, ["day", "model"], ["total"]).where("total <> 0").groupBy("day").agg(
        F.count(F.lit(1)).alias("models"))
    hours = hour_vector(hourly(cube, ["day"]), ["day"]).select(
        "day", F.size(F.filter("hours", lambda h: h > 0)).cast("bigint").alias("active_hours"),
        best_four_hours(F.col("hours")).alias("four"))
    places = projects.groupBy("day", "entity").agg(F.sum("total").alias("total")).where("total > 0").groupBy("day").agg(
        F.count(F.lit(1)).alias("projects"))
    rows = beside(["day"], days, models, hours, places)
    none = F.lit(0).cast("bigint")
    return rows.select(
        "day", "total", "calls",
        F.coalesce(F.try_divide("cache_read", "total"), F.lit(0.0)).alias("cache_ratio"),
        *[F.coalesce(c, none).alias(c) for c in ("models", "projects", "active_hours")],
        F.coalesce(F.try_divide("four", "total"), F.lit(0.0)).alias("four_hour_share"))


def classify(features: DataFrame) -> DataFrame:
    """First rule that holds. The median comes from days that reach the minimum."""
    median = F.median(F.when(F.col("total") >= MINIMUM_VOLUME, F.col("total"))).over(W.partitionBy())
    rows = features.withColumn("median", F.coalesce(median, F.lit(0.0)))
    mode = (
        F.when(F.col("total") < MINIMUM_VOLUME, "insufficient")
        .when(F.col("cache_ratio") >= CACHE_RATIO, "cache")
        .when((F.col("models") >= EXPLORE_MODELS) | (F.col("projects") >= EXPLORE_PROJECTS), "explore")
        .when(F.col("active_hours").between(1, DEEP_HOURS) & (F.col("four_hour_share") >= DEEP_SHARE), "deep")
        .when((F.col("median") > 0) & (F.col("total") >= F.col("median") * SPRINT_MULTIPLE), "sprint")
        .otherwise("cruise")
    )
    return rows.withColumn("mode", mode)


def mode_counts(classified: DataFrame) -> DataFrame:
    """Days per mode and share of all classified days."""
    counts = classified.where("mode <> 'insufficient'").groupBy("mode").agg(F.count(F.lit(1)).alias("days"))
    return counts.withColumn("share", share(F.col("days"), F.sum("days").over(W.partitionBy())))
