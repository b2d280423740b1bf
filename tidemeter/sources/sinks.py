"""Published outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.functions import calendar as cal
from tidemeter.functions.volumes import share
from tidemeter.operators.cube import additive
from tidemeter.operators.periods import period_model, wide
from tidemeter.operators.rhythm import hourly
from tidemeter.schema import PARTS


def write_period_csv(period_rows: DataFrame, models: Sequence[str], path: str) -> None:
    """Period, total, one column per model, calls; quotes are doubled inside fields."""
    table = wide(period_rows, models).withColumnRenamed("total", "total_volume")
    named = table.withColumn("period", cal.iso(F.col("period")))
    named.repartition(1).sortWithinPartitions("period").write.option("header", "true").option(
        "quote", '"').option("escape", '"').mode("overwrite").csv(path)


def write_history_json(history: DataFrame, scope: str, path: str) -> None:
    """One scope of the snapshot history; at most the kept snapshots."""
    history.where(F.col("scope") == scope).write.mode("overwrite").json(path)


def report_row(cube: DataFrame) -> DataFrame:
    """Headline numbers of a report in one row, without joining anything."""
    models = additive(cube, ["model"], ["total", "calls", "cache_read"]).select(
        F.lit("model").alias("kind"), F.col("model").alias("member"), "total", "calls", "cache_read",
        F.lit(0).alias("tie"))
    hours = hourly(cube, []).select(
        F.lit("hour").alias("kind"), F.col("hour").cast("string").alias("member"), "total",
        F.lit(None).cast("bigint").alias("calls"), F.lit(None).cast("bigint").alias("cache_read"),
        (-F.col("hour")).alias("tie"))
    ranked = models.unionByName(hours).withColumn("_r", F.row_number().over(
        W.partitionBy("kind").orderBy(F.desc("total"), F.desc("tie"), "member")))
    model, hour = F.col("kind") == "model", F.col("kind") == "hour"
    row = ranked.agg(
        F.sum(F.when(model, F.col("total"))).alias("total"),
        F.sum("calls").alias("calls"),
        F.sum("cache_read").alias("cache_read"),
        F.max(F.when(hour & (F.col("_r") == 1), F.col("member"))).cast("bigint").alias("peak_hour"),
        F.max(F.when(model & (F.col("_r") == 1), F.col("member"))).alias("dominant_model"))
    night = (F.col("peak_hour") < 6) | (F.col("peak_hour") >= 22)
    return row.withColumn("cache_share", share(F.col("cache_read"), F.col("total"))).withColumn(
        "persona", F.when(night, "night").otherwise("day"))


def nested_periods(cube: DataFrame) -> DataFrame:
    """Published form: per grain and period, totals with maps per model.

    Maps are built from at most one entry per seated model.
    """
    rows = period_model(cube)
    by_model = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", value))))
    return rows.groupBy("grain", "period").agg(
        F.sum("total").alias("total"), F.sum("calls").alias("calls"),
        by_model(F.col("total").alias("v")).alias("models"),
        by_model(F.col("calls").alias("v")).alias("model_calls"),
        by_model(F.array(*PARTS).alias("v")).alias("reuse"),
    ).withColumn("period", cal.iso(F.col("period")))


def write_document(cube: DataFrame, path: str) -> None:
    nested_periods(cube).write.partitionBy("grain").mode("overwrite").json(path)
