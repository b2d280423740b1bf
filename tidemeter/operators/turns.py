"""Per-session turn sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.functions.volumes import share, zero

# Fixed value: turns kept per session for replay.
REPLAY_TURNS = 200


def replay(rec: DataFrame, keep: int = REPLAY_TURNS) -> DataFrame:
    """Most recent turns of each session in order, with running sum and share.

    Order is the raw timestamp text, then arrival. The rank filter plans a group limit
    below the shuffle, so a session with a third of all rows sends ``keep`` rows per
    map task. Running values are computed over the kept turns only.
    """
    latest = W.partitionBy("session").orderBy(
        F.desc("_ts"), F.desc("file_path"), F.desc("block"), F.desc("seq"), F.desc("total"))
    slim = rec.where(F.col("session") != "").select(
        "session", F.coalesce("ts_raw", F.lit("")).alias("_ts"), "file_path", "block", "seq",
        zero(F.col("total")).alias("total"))
    kept = slim.withColumn("_back", F.row_number().over(latest)).where(F.col("_back") <= keep)
    running = W.partitionBy("session").orderBy(F.desc("_back")).rowsBetween(W.unboundedPreceding, 0)
    return kept.select(
        "session",
        F.row_number().over(W.partitionBy("session").orderBy(F.desc("_back"))).cast("bigint").alias("turn"),
        "total",
        F.sum("total").over(running).alias("running"),
        F.sum("total").over(W.partitionBy("session")).alias("_all"),
    ).withColumn("running_share", share(F.col("running"), F.col("_all"))).drop("_all")


def replay_counts(sessions: DataFrame, keep: int = REPLAY_TURNS) -> DataFrame:
    """Eligible and retained turns, from a session cube alone."""
    per = sessions.groupBy("entity").agg(F.sum("calls").alias("turns"))
    return per.agg(
        F.coalesce(F.sum("turns"), F.lit(0).cast("bigint")).alias("replay_eligible"),
        F.coalesce(F.sum(F.least("turns", F.lit(keep).cast("bigint"))), F.lit(0).cast("bigint")).alias("replay_retained"),
        F.coalesce(F.max("turns"), F.lit(0).cast("bigint")).alias("max_turns"),
    )


def running_max_turns(cube: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per observed day, the longest session so far, counted in cumulative turns.

    ``sessions`` is a session cube by day; the per-session window holds one row per
    active day of that session.
    """
    per_day = sessions.groupBy("entity", "day").agg(F.sum("calls").alias("turns"))
    so_far = F.sum("turns").over(
        W.partitionBy("entity").orderBy("day").rowsBetween(W.unboundedPreceding, 0))
    return _longest_so_far(cube, per_day.withColumn("so_far", so_far).groupBy("day").agg(F.max("so_far").alias("best")))


def running_max_from(cube: DataFrame, done: DataFrame) -> DataFrame:
    """``running_max_turns`` from an entity pass over sessions."""
    return _longest_so_far(cube, done.where("part = 'day'").select("day", "best"))


def _longest_so_far(cube: DataFrame, best: DataFrame) -> DataFrame:
    observed = cube.select("day", F.lit(None).cast("bigint").alias("best"))
    days = best.unionByName(observed).groupBy("day").agg(F.max("best").alias("best"))
    return days.select(
        "day",
        F.coalesce(F.max("best").over(W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)),
                   F.lit(0).cast("bigint")).alias("max_turns"),
    )
