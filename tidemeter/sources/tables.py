"""Adapters from relational tables to the canonical record.

Both map whole tables row by row; neither joins nor shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.schema import RECORD


def _record(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in RECORD])


def _long(col: Column) -> Column:
    return col.cast("bigint")


def _event_fields(df: DataFrame) -> DataFrame:
    k = _long(F.get_json_object("props", "$.k"))
    return df.select(
        "*", k.alias("k"),
        F.expr("user_id div 3").alias("u"),
        F.when(F.col("user_id") % 3 == 0, "claude").when(F.col("user_id") % 3 == 1, "gemini")
        .otherwise("codex").alias("source"),
        (F.col("event_id") % 97 == 0).alias("bad"),
    )


def event_usage(df: DataFrame, when: Column) -> DataFrame:
    """Events with usage columns; ``when`` is the local wall-clock time of the event."""
    src, k = F.col("source"), F.col("k")
    n = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    base = _event_fields(df).withColumn("w", when).withColumn("day", F.to_date("w"))
    base = (
        base.withColumn("input", F.when(k % 40 != 39, _long(F.round(F.col("value") * 100))))
        .withColumn("output", F.when(k % 25 != 24, k * 5 + 3))
        .withColumn("cache_read", F.when(k % 10 != 9, k * 7))
        .withColumn("cache_write", F.when(src != "claude", F.lit(0).cast("bigint")).when(k % 50 != 49, k * 2))
    )
    inp, out, read, write = (n(F.col(c)) for c in ("input", "output", "cache_read", "cache_write"))
    week = F.date_format(F.date_trunc("week", F.col("day")), "yyyyMMdd")
    return (
        base.withColumn(
            "total",
            F.when(src == "claude", inp + out + read + write)
            .when(src == "gemini", inp + out + read + k)
            .otherwise(inp + out),
        )
        .withColumn("ts", F.when(~F.col("bad"), F.col("w").cast("timestamp")))
        .withColumn("hour", F.when(~F.col("bad"), F.hour("w")))
        .withColumn(
            "ts_raw",
            F.when(F.col("bad"), F.lit("not-a-time"))
            .otherwise(F.date_format("w", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
        )
        .withColumn("model", F.when(F.col("event_id") % 101 != 0, F.col("event_type")))
        .withColumn("session", F.when(src != "codex", F.concat(F.lit("s"), F.col("user_id"), F.lit("-"), week)))
        .withColumn(
            "project",
            F.when((src == "claude") & (F.col("u") % 12 != 11),
                   F.concat(F.lit("/srv/team"), F.col("u") % 5, F.lit("/app"), F.col("u") % 12)),
        )
        .withColumn("file_path", F.lit("events"))
        .withColumn("block", F.lit(0))
        .withColumn("seq", F.col("event_id"))
    )


def events_as_usage(events: DataFrame) -> DataFrame:
    """Row-wise mapping, usable on a batch or a stream of events."""
    return _record(event_usage(events, F.col("ts")))


def usage_events(spark: SparkSession, root: str) -> DataFrame:
    """Events as usage records: 30 dense days, every hour, some missing fields."""
    return events_as_usage(spark.read.parquet(f"{root}/events.parquet"))


def gaps_as_usage(events: DataFrame) -> DataFrame:
    """Events on a stretched calendar, so that quiet days and long gaps occur."""
    off = F.datediff(F.col("ts"), F.lit("2024-01-01").cast("date"))
    shift = (F.floor(off / 4) * 3 + F.floor(off / 11) * 7).cast("int")
    return _record(event_usage(events, F.col("ts") + F.make_dt_interval(shift)))


def usage_gaps(spark: SparkSession, root: str) -> DataFrame:
    return gaps_as_usage(spark.read.parquet(f"{root}/events.parquet"))


def usage_lines(spark: SparkSession, root: str) -> DataFrame:
    """Order lines as usage records: seven years, 25 models, high-cardinality sessions."""
    df = spark.read.parquet(f"{root}/lineitem.parquet")
    qty = _long(F.col("l_quantity"))
    src = F.when(F.col("l_returnflag") == "A", "claude").when(
        F.col("l_returnflag") == "N", "gemini").otherwise("codex")
    when = F.col("l_shipdate") + F.make_dt_interval(F.lit(0), (F.col("l_partkey") % 24).cast("int"))
    inp, out = _long(F.round("l_extendedprice")), qty * 10
    read = _long(F.round(F.col("l_discount") * 1000)) * qty * 5
    write = _long(F.round(F.col("l_tax") * 100)) * qty
    return _record(
        df.select(
            src.alias("source"),
            F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts_raw"),
            when.cast("timestamp").alias("ts"),
            F.to_date("l_shipdate").alias("day"),
            (F.col("l_partkey") % 24).alias("hour"),
            F.concat(F.lit("brand-"), F.col("l_partkey") % 25).alias("model"),
            inp.alias("input"), out.alias("output"), read.alias("cache_read"),
            F.when(src == "claude", write).otherwise(F.lit(0).cast("bigint")).alias("cache_write"),
            F.when(src == "claude", inp + out + read + write)
            .when(src == "gemini", inp + out + read).otherwise(inp + out).alias("total"),
            F.concat(F.lit("o"), "l_orderkey").alias("session"),
            F.concat(F.lit("/plant"), F.col("l_suppkey") % 10, F.lit("/bay"), "l_suppkey").alias("project"),
            F.lit("lineitem").alias("file_path"),
            F.lit(0).alias("block"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        )
    )
