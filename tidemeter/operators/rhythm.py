"""Hour-of-day answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.functions import calendar as cal
from tidemeter.functions.volumes import share
from tidemeter.operators.cube import additive

# Hour ranges of bands, indices and persona rules.
BANDS = (("late", 0, 6), ("morning", 6, 12), ("afternoon", 12, 18), ("evening", 18, 24))
INDICES = (("morning", 6, 11), ("work", 9, 18), ("evening", 18, 22))
MATRIX_DAYS = 14


def timed(cube: DataFrame) -> DataFrame:
    """Rows with a known hour."""
    return cube.where(F.col("hour").isNotNull() if "hour" in cube.columns else F.col("timed"))


def in_hours(lo: int, hi: int) -> Column:
    return (F.col("hour") >= lo) & (F.col("hour") < hi)


def is_night() -> Column:
    return in_hours(0, 6) | (F.col("hour") >= 22)


def band() -> Column:
    expr = F.lit(None).cast("string")
    for name, lo, hi in reversed(BANDS):
        expr = F.when(in_hours(lo, hi), name).otherwise(expr)
    return expr


def _sum_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("total"))), F.lit(0).cast("bigint"))


def hourly(cube: DataFrame, keys: list[str]) -> DataFrame:
    return additive(timed(cube), [*keys, "hour"], ["total"])


def hour_vector(hours: DataFrame, keys: list[str]) -> DataFrame:
    """24 fixed sums per key: the vector's length is known, so no list is collected."""
    slots = [_sum_if(F.col("hour") == h) for h in range(24)]
    return hours.groupBy(*keys).agg(F.array(*slots).alias("hours"))


def rhythm_summary(cube: DataFrame) -> DataFrame:
    """Peak hour (first maximum), night volume and the four band totals."""
    per_hour = hourly(cube, [])
    return per_hour.agg(
        F.max_by("hour", F.struct("total", -F.col("hour"))).cast("bigint").alias("peak_hour"),
        F.max("total").alias("peak_total"),
        _sum_if(is_night()).alias("night_volume"),
        *[_sum_if(in_hours(lo, hi)).alias(f"{name}_volume") for name, lo, hi in BANDS],
    )


def hour_indices(cube: DataFrame) -> DataFrame:
    """Shares of the day's parts, and how many hours of the clock are used."""
    per_hour = hourly(cube, [])
    whole = F.sum("total")
    active = F.col("total") > 0
    return per_hour.agg(
        share(_sum_if(is_night()), whole).alias("night_index"),
        *[share(_sum_if(in_hours(lo, hi)), whole).alias(f"{name}_index") for name, lo, hi in INDICES],
        F.count_if(active).alias("active_hours"),
        F.round(F.avg(F.when(active, F.col("total"))), 4).alias("active_hour_mean"),
        F.max("total").alias("peak_hour_total"),
    )


def weekday_totals(cube: DataFrame) -> DataFrame:
    daily = additive(cube, ["day"], ["total"])
    return additive(daily.withColumn("weekday", cal.weekday(F.col("day")).cast("bigint")), ["weekday"], ["total"])


def month_totals(cube: DataFrame) -> DataFrame:
    daily = additive(cube, ["day"], ["total"])
    return additive(daily.withColumn("month", F.month("day").cast("bigint")), ["month"], ["total"])


def weekday_hour(cube: DataFrame) -> DataFrame:
    rows = hourly(cube, ["day"]).withColumn("weekday", cal.weekday(F.col("day")).cast("bigint"))
    return additive(rows, ["weekday", "hour"], ["total"])


def model_band(cube: DataFrame) -> DataFrame:
    return additive(hourly(cube, ["model"]).withColumn("band", band()), ["model", "band"], ["total"])


def month_band(cube: DataFrame) -> DataFrame:
    rows = hourly(cube, ["day"]).withColumn("month", F.month("day").cast("bigint")).withColumn("band", band())
    return additive(rows, ["month", "band"], ["total"])


def activity_matrix(cube: DataFrame, end: str, days: int = MATRIX_DAYS) -> DataFrame:
    """Last days x 24 hours with a 0-4 level by min-max of the positive cells.

    The spine is generated from the end day, so it has ``days * 24`` rows.
    """
    spark = cube.sparkSession
    last = F.lit(end).cast("date")
    spine = spark.range(1).select(
        F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day")
    ).select("day", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    recent = cube.where(F.col("day").between(F.date_sub(last, days - 1), last))
    cells = spine.join(hourly(recent, ["day"]), ["day", "hour"], "left").withColumn(
        "total", F.coalesce("total", F.lit(0).cast("bigint"))
    )
    positive = F.when(F.col("total") > 0, F.col("total"))
    everywhere = W.partitionBy()
    lo, hi = F.min(positive).over(everywhere), F.max(positive).over(everywhere)
    scaled = F.ceil((F.col("total") - lo) / (hi - lo) * 4)
    level = (
        F.when(F.col("total") == 0, 0)
        .when(hi <= lo, 4)
        .otherwise(F.least(F.greatest(scaled, F.lit(1).cast("bigint")), F.lit(4).cast("bigint")))
    )
    return cells.select(
        "day", F.col("hour").cast("bigint").alias("hour"), "total", level.cast("bigint").alias("level"),
        share(F.col("total"), F.sum("total").over(W.partitionBy("day"))).alias("day_share"),
    )


def persona(matrix: DataFrame) -> DataFrame:
    """Rhythm label of a matrix; the first rule that holds wins."""
    per_hour = matrix.groupBy("hour").agg(F.sum("total").alias("total"))
    facts = per_hour.agg(
        F.sum("total").alias("total"),
        _sum_if(is_night()).alias("night"),
        _sum_if(in_hours(5, 10)).alias("dawn"),
        _sum_if(in_hours(17, 22)).alias("dusk"),
        F.count_if(F.col("total") > 0).alias("active_hours"),
    )
    label = (
        F.when((F.col("total") > 0) & (F.col("night") > F.col("total") * 0.42), "night")
        .when((F.col("total") > 0) & (F.col("dawn") > F.col("total") * 0.38), "dawn")
        .when((F.col("total") > 0) & (F.col("dusk") > F.col("total") * 0.4), "dusk")
        .when(F.col("active_hours") >= 20, "all_hours")
        .otherwise("day")
    )
    return facts.withColumn("persona", label)


def recent_hours(cube: DataFrame, generated: str, count: int = 6) -> DataFrame:
    """Hourly totals of the last hours up to the generation time (local wall clock)."""
    spark = cube.sparkSession
    now = F.date_trunc("hour", F.lit(generated).cast("timestamp_ntz"))
    hour = F.expr("interval 1 hour")
    spine = spark.range(count).select(
        (now - hour * (F.lit(count - 1) - F.col("id"))).alias("at"), F.col("id").alias("position")
    ).select("position", F.to_date("at").alias("day"), F.hour("at").alias("hour"))
    first = F.to_date(now - hour * (count - 1))
    recent = cube.where(F.col("day").between(first, F.to_date(now)))
    return spine.join(hourly(recent, ["day"]), ["day", "hour"], "left").select(
        "position", "day", F.col("hour").cast("bigint").alias("hour"),
        F.coalesce("total", F.lit(0).cast("bigint")).alias("total"),
    )


def highlights(cube: DataFrame) -> DataFrame:
    """Highest-volume day (earliest on ties) and busiest hour."""
    daily = additive(cube, ["day"], ["total"]).select(
        F.lit("top_day").alias("kind"), cal.iso(F.col("day")).alias("member"), "total",
        (-cal.day_number(F.col("day"))).alias("tie"),
    )
    hours = hourly(cube, []).select(
        F.lit("top_hour").alias("kind"), F.col("hour").cast("string").alias("member"), "total",
        (-F.col("hour")).alias("tie"),
    )
    key = F.struct("total", "tie")
    return daily.unionByName(hours).groupBy("kind").agg(
        F.max_by("member", key).alias("member"), F.max("total").alias("total")
    )
