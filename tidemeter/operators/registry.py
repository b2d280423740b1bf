"""Stable model identities: seven seats by first appearance, the rest fold into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number of seats and the name of the folded remainder.
CAPACITY = 7
OTHER = "other"


def model_activity(cube: DataFrame) -> DataFrame:
    """Per model: when it was first seen and its latest activity.

    First seen ranks a valid time before a bare date. Latest compares the day, then
    whether that day has a valid time, then the time.
    """
    daily = cube.groupBy("model", "day").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    return daily.where(F.col("model") != OTHER).groupBy("model").agg(
        F.min("first_ts").alias("first_ts"),
        F.min("day").alias("first_day"),
        F.max(F.struct("day", F.col("last_ts").isNotNull().alias("timed"), "last_ts")).alias("latest"),
    )


def _first_rank() -> tuple[Column, ...]:
    return (F.col("first_ts").isNull(), F.col("first_ts"), F.col("first_day"), F.col("model"))


def registry(cube: DataFrame) -> DataFrame:
    """(model, slot) of the seated models: at most seven rows, whatever the input.

    Both rankings are top-k limits, so no window ever holds all models. The most
    recently active model takes the last seat when it arrived too late for one.
    """
    return seats(model_activity(cube))


def seats(activity: DataFrame) -> DataFrame:
    """The registry from (model, first_ts, first_day, latest), be it computed now or maintained."""
    first = activity.orderBy(*_first_rank()).limit(CAPACITY).withColumn("role", F.lit("seat"))
    newest = activity.orderBy(F.desc("latest"), F.desc("model")).limit(1).withColumn("role", F.lit("newest"))
    # Both branches carry every column, so they share one pass over the cube.
    rank = F.struct(
        F.col("first_ts").isNull().alias("untimed"), F.col("first_ts"), F.col("first_day"), F.col("model"))
    both = first.unionByName(newest).agg(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("role") == "seat", rank))), lambda r: r["model"]
        ).alias("seated"),
        F.max(F.when(F.col("role") == "newest", F.struct("latest", "model")))["model"].alias("newest"),
    )
    final = F.when(
        F.array_contains("seated", F.col("newest")), F.col("seated")
    ).otherwise(F.concat(F.slice("seated", 1, CAPACITY - 1), F.array("newest")))
    return both.where(F.size("seated") > 0).select(F.posexplode(final).alias("slot", "model")).select(
        "model", F.col("slot").cast("bigint").alias("slot")
    )


def fold(df: DataFrame, slots: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Replace unseated models by ``other``. Broadcasting is safe: slots has <= 7 rows."""
    seated = F.broadcast(slots.select(F.col("model").alias("_seat")))
    out = df.join(seated, df["model"] == F.col("_seat"), "left")
    if keep_raw:
        out = out.withColumn("raw_model", F.col("model"))
    return out.withColumn("model", F.coalesce("_seat", F.lit(OTHER))).drop("_seat")


def slot_table(cube: DataFrame) -> DataFrame:
    """Every model with its seat; folded models share the last slot."""
    slots = registry(cube)
    return (
        cube.select("model").distinct()
        .join(F.broadcast(slots), "model", "left")
        .select(
            "model",
            F.when(F.col("slot").isNull(), OTHER).otherwise(F.col("model")).alias("identity"),
            F.coalesce("slot", F.lit(CAPACITY).cast("bigint")).alias("slot"),
        )
    )


def folded_cube(cube: DataFrame) -> DataFrame:
    """The cube under registry names. Seats come from all records, before range filters."""
    return fold(cube, registry(cube))


def latest_backend(cube: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """Most recently active model in range, its seat, and whether it was folded."""
    from tidemeter.operators.cube import in_range

    slots = registry(cube)
    daily = in_range(cube, since, until).groupBy("model", "day").agg(F.max("last_ts").alias("last_ts"))
    folded = fold(daily, slots, keep_raw=True)
    key = F.struct("day", F.col("last_ts").isNotNull().alias("timed"), "last_ts",
                   F.col("raw_model").alias("raw"))
    return folded.agg(
        F.max_by("model", key).alias("latest_backend"),
        F.max_by("raw_model", key).alias("raw_model"),
    ).withColumn("folded", F.col("latest_backend") != F.col("raw_model"))
