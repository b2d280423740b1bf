"""Seasons, personal records and snapshot history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.functions import calendar as cal
from tidemeter.functions.volumes import share
from tidemeter.operators.cube import additive, beside
from tidemeter.operators.periods import dominant
from tidemeter.operators.sequence import islands

# Season and record rules, history limits.
QUIET_BREAK = 8
YOUNG_DAYS = 5
SURGE_CV, STEADY_CV = 1.15, 0.28
RATIO_FLOOR = 1000
KEEP_SNAPSHOTS, KEEP_SCOPES = 24, 8

def label_seasons(days: DataFrame) -> DataFrame:
    """Active days with a season number: a new month or a gap of eight days starts one."""
    active = days.where("total > 0")
    time = W.orderBy("day")
    before = F.lag("day").over(time)
    fresh = (
        before.isNull() | (F.trunc("day", "month") != F.trunc(before, "month"))
        | (F.datediff("day", before) >= QUIET_BREAK)
    )
    return active.withColumn("_new", fresh.cast("int")).withColumn(
        "season", F.sum("_new").over(time.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def seasons(cube: DataFrame, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row per season with its totals, peak, dominant model, streak and character."""
    days = additive(cube, ["day"], ["total", "calls", "cache_read"])
    labelled = label_seasons(days)
    models = additive(cube, ["day", "model"], ["total"]).join(labelled.select("day", "season"), "day")
    lead = dominant(["season"], additive(models, ["season", "model"], ["total"])).select(
        "season", F.col("model").alias("dominant_model"), F.col("total").alias("_lead"))
    runs = islands(labelled, ["season"]).groupBy("season").agg(F.max("length").alias("longest_streak"))
    facts = labelled.groupBy("season").agg(
        F.min("day").alias("start"), F.max("day").alias("end"),
        *[F.sum(c).alias(c) for c in ("total", "calls", "cache_read")],
        F.count(F.lit(1)).alias("active_days"),
        F.max_by("day", F.struct("total", -cal.day_number(F.col("day")))).alias("peak_day"),
        F.max("total").alias("peak_total"),
        F.try_divide(F.stddev_pop("total"), F.avg("total")).alias("_cv"),
    )
    bound = lambda day, col: F.lit(False) if day is None else F.col(col) == F.lit(day).cast("date")
    rows = facts.join(lead, "season", "left").join(runs, "season").withColumn(
        "_before", F.lag("dominant_model").over(W.orderBy("season")))
    return rows.select(
        "season", "start", "end", "total", "calls", "cache_read", "active_days",
        (F.datediff("end", "start") + 1).cast("bigint").alias("span_days"),
        "dominant_model", share(F.coalesce("_lead", F.lit(0)), F.col("total")).alias("dominant_share"),
        "peak_day", "peak_total", "longest_streak",
        bound(since, "start").alias("truncated_start"), bound(until, "end").alias("truncated_end"),
        character(F.col("active_days"), F.col("dominant_model"), F.col("_before"), F.col("_cv")).alias("character"),
    )


def character(active: Column, lead: Column, lead_before: Column, cv: Column) -> Column:
    """First matching description of a season."""
    return (
        F.when(active == 0, "quiet").when(active < YOUNG_DAYS, "incipient")
        .when(lead.isNotNull() & lead_before.isNotNull() & (lead != lead_before), "migration")
        .when(cv >= SURGE_CV, "surge").when(cv <= STEADY_CV, "steady").otherwise("echo")
    )


def record_days(cube: DataFrame, turns: DataFrame) -> DataFrame:
    """Per day, every metric a personal record is kept for."""
    days = additive(cube, ["day"], ["total", "calls", "input", "output", "cache_read", "cache_write"])
    hours = additive(cube.where("hour is not null"), ["day", "hour"], ["total"]).groupBy("day").agg(
        F.max("total").alias("peak_hour_total"))
    models = additive(cube, ["day", "model"], ["total"]).where("total > 0").groupBy("day").agg(
        F.count(F.lit(1)).alias("models"))
    return beside(["day"], days, hours, models, turns)


def personal_records(rows: DataFrame) -> DataFrame:
    """Best value of each metric with its earliest day, and the longest active streak."""
    ratio = F.when(F.col("total") >= RATIO_FLOOR, F.col("cache_read") / F.col("total"))
    metrics = {
        "peak-day-token": F.col("total"), "peak-day-calls": F.col("calls"),
        "peak-hour-token": F.col("peak_hour_total"), "peak-day-cache": F.col("cache_read"),
        "peak-cache-ratio": ratio, "peak-day-input": F.col("input"), "peak-day-output": F.col("output"),
        "peak-day-cache-write": F.col("cache_write"), "max-session-turns": F.col("max_turns"),
        "peak-model-diversity": F.col("models"),
    }
    long = rows.select("day", F.explode(F.array(*[
        F.struct(F.lit(k).alias("id"), v.cast("double").alias("value")) for k, v in metrics.items()
    ])).alias("m")).select("day", "m.*").where("value > 0")
    best = long.groupBy("id").agg(
        F.round(F.max("value"), 6).alias("value"),
        F.max_by("day", F.struct("value", -cal.day_number(F.col("day")))).alias("achieved"))
    streak = islands(rows).agg(
        F.max("length").cast("double").alias("value"),
        F.max_by("end", F.struct("length", -cal.day_number(F.col("end")))).alias("achieved"),
    ).where("value is not null").select(F.lit("longest-active-streak").alias("id"), "value", "achieved")
    return best.unionByName(streak)


def against_history(current: DataFrame, history: DataFrame) -> DataFrame:
    """Each current record against the best of earlier snapshots.

    ``history`` is (generated, id, value, achieved); the first snapshot to reach the best
    value is the one compared with.
    """
    ranked = history.withColumn("_r", F.row_number().over(
        W.partitionBy("id").orderBy(F.desc("value"), "generated")))
    prior = ranked.where("_r = 1").select(
        "id", F.col("value").alias("prior_value"), F.col("achieved").alias("prior_achieved"))
    status = (
        F.when(F.col("prior_value").isNull(), "baseline")
        .when(F.col("value") > F.col("prior_value"), "broken")
        .when((F.col("value") == F.col("prior_value")) & (F.col("achieved") != F.col("prior_achieved")), "tied")
        .when(F.col("value") == F.col("prior_value"), "standing").otherwise("historic")
    )
    return current.join(prior, "id", "left").select(
        "id", "value", "achieved", "prior_value", status.alias("status"),
        F.round(F.col("value") - F.col("prior_value"), 6).alias("delta"))


def upsert_history(
    history: DataFrame, fresh: DataFrame, keep: int = KEEP_SNAPSHOTS, scopes: int = KEEP_SCOPES, recency: str = "generated"
) -> DataFrame:
    """Replace snapshots with the same id, keep the latest per scope and the latest scopes.

    Both frames are (scope, id, generated, ...). Scope ``recency`` is ranked on one row per scope.
    """
    old = history.join(fresh.select("scope", "id").distinct(), ["scope", "id"], "left_anti")
    rows = old.unionByName(fresh)
    ranked = rows.withColumn("_n", F.row_number().over(
        W.partitionBy("scope").orderBy(F.desc("generated"), F.desc("id"))))
    kept = ranked.where(F.col("_n") <= keep).drop("_n")
    latest = kept.groupBy("scope").agg(F.max(recency).alias("_u")).orderBy(F.desc("_u"), "scope").limit(scopes)
    return kept.join(F.broadcast(latest.select("scope")), "scope", "left_semi")


def story_facts(snapshots: DataFrame) -> DataFrame:
    """What changed between consecutive snapshots of each scope.

    Input is (scope, generated, volume, dominant_model, season_id, records_broken).
    """
    w = W.partitionBy("scope").orderBy("generated")
    lag = lambda c: F.lag(c).over(w)
    prev = lag("volume")
    rows = snapshots.select(
        "*", prev.alias("_t"), lag("dominant_model").alias("_m"), lag("season_id").alias("_s"),
        lag("generated").alias("previous_generated"))
    return rows.select(
        "scope", "generated", "previous_generated", "volume",
        (F.col("volume") - F.col("_t")).alias("delta"),
        F.round(F.try_divide(F.col("volume") - F.col("_t"), F.col("_t")), 6).alias("ratio"),
        F.coalesce((F.col("_m") != F.col("dominant_model")), F.lit(False)).alias("model_changed"),
        F.when(F.col("_s").isNull(), "baseline").when(F.col("_s") == F.col("season_id"), "continued")
        .otherwise("new").alias("season_state"),
        "records_broken")
