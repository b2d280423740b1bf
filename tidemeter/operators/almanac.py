"""Snapshots of a report, compared with those stored before.

A snapshot is one row: its identity, totals, models, personal records and seasons. All lists in it are bounded by
the calendar or by fixed metric and model counts, so a snapshot never grows with the records behind it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.functions import calendar as cal
from tidemeter.operators import seasons as ss
from tidemeter.operators import turns as tn
from tidemeter.operators.cube import additive
from tidemeter.operators.snapshot import snapshot_id

# Precision flags, and the records that are no exact-day number.
EXACT, RANGE_DAY, BOUNDARY = "exact-day", "range-day", "range-boundary"
SHARES = ("peak-cache-ratio",)
STREAK, PEAK_HOUR, TURNS = "longest-active-streak", "peak-hour-token", "max-session-turns"

RECORD = "struct<id:string,value:double,achieved:string,precision:string,detail:string,format:string>"
SEASON = ("struct<id:string,start:string,end:string,total:bigint,calls:bigint,active_days:bigint,span_days:bigint,dominant_model:string,"
          "dominant_share:double,peak_day:string,peak_total:bigint,longest_streak:bigint,character:string>")
SNAPSHOT = (f"scope string, id string, generated string, first_day string, last_day string, tokens bigint, calls bigint, cache bigint, "
            f"models map<string,bigint>, records array<{RECORD}>, seasons array<{SEASON}>, updated string")


def scope_key(
    sources: Iterable[str] = (), since: str | None = None, until: str | None = None, zone: str = "UTC",
    hidden: bool = False, schema: int = 1,
) -> str:
    """What snapshots must share to be compared: raw and hidden reports, ranges and zones never mix."""
    return "|".join(("hidden" if hidden else "raw", ",".join(sorted(sources)) or "all", since or "all",
                     f"until {until}" if until else "rolling", zone, f"m{schema}"))


def record_details(cube: DataFrame, sessions: DataFrame) -> DataFrame:
    """Personal records with what is known of their day: (id, value, achieved, precision, detail, format).

    ``detail`` is the hour of an hour's record and the end of a streak. A streak that fills the range from its first
    day may have begun before it, and turns count over the range, so neither names an exact day.
    """
    rows = ss.record_days(cube, tn.running_max_turns(cube, sessions))
    best = ss.personal_records(rows)
    hours = additive(cube.where("hour is not null"), ["day", "hour"], ["total"]).where("total > 0").groupBy("day").agg(
        F.max_by("hour", F.struct("total", -F.col("hour"))).alias("hour"))
    time = W.orderBy("day")
    days = rows.select("day", F.row_number().over(time).alias("_n"), (F.first("total").over(time) > 0).alias("_begun")).join(hours, "day", "left")
    streak = F.col("id") == STREAK
    return best.join(days, best["achieved"] == days["day"], "left").select(
        "id", "value", cal.iso(F.col("achieved")).alias("achieved"),
        F.when(F.col("id") == TURNS, RANGE_DAY)
        .when(streak & F.col("_begun") & (F.col("_n") == F.col("value")), BOUNDARY).otherwise(EXACT).alias("precision"),
        F.when(F.col("id") == PEAK_HOUR, F.format_string("%02d:00", F.col("hour").cast("int")))
        .when(streak, cal.iso(F.col("achieved"))).otherwise("").alias("detail"),
        F.when(F.col("id").isin(*SHARES), "percent").otherwise("number").alias("format"))


def _in_one_row(*parts: DataFrame) -> DataFrame:
    """Frames of one row and different columns, side by side without a join."""
    names = {f.name: f.dataType for part in parts for f in part.schema.fields}
    stacked = [part.select(*[F.col(n) if n in part.columns else F.lit(None).cast(t).alias(n) for n, t in names.items()]) for part in parts]
    rows = stacked[0]
    for part in stacked[1:]:
        rows = rows.unionByName(part)
    return rows.agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])


def summarise(
    cube: DataFrame, sessions: DataFrame, scope: str, generated: str, since: str | None = None, until: str | None = None,
) -> DataFrame:
    """The snapshot of a report: ``cube`` by day, hour, source and model, ``sessions`` by day and entity."""
    listed = lambda c: F.array_sort(F.collect_list(c))
    totals = additive(cube, ["model"], ["total", "calls", "cache_read"])
    models = totals.agg(
        F.sum("total").alias("tokens"), F.sum("calls").alias("calls"), F.sum("cache_read").alias("cache"),
        F.map_from_entries(listed(F.struct("model", "total"))).alias("models"))
    records = record_details(cube, sessions).agg(
        listed(F.struct("id", "value", "achieved", "precision", "detail", "format")).alias("records"))
    day = lambda c: cal.iso(F.col(c)).alias(c)
    found = ss.seasons(cube, since, until).select(
        F.concat_ws("..", cal.iso(F.col("start")), cal.iso(F.col("end"))).alias("id"), day("start"), day("end"), "total", "calls",
        "active_days", "span_days", "dominant_model", "dominant_share", day("peak_day"), "peak_total", "longest_streak", "character")
    seasons = found.agg(listed(F.struct(*found.columns)).alias("seasons"))
    row = _in_one_row(snapshot_id(cube).withColumnRenamed("snapshot_id", "id"), models, records, seasons)
    return row.select(
        F.lit(scope).alias("scope"), "id", F.lit(generated).alias("generated"), "first_day", "last_day", "tokens", "calls", "cache",
        "models", F.col("records").cast(f"array<{RECORD}>").alias("records"), F.col("seasons").cast(f"array<{SEASON}>").alias("seasons"),
        F.lit(generated).alias("updated"))


def earlier(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored snapshots of the scopes of ``fresh``, without those it replaces."""
    return history.join(fresh.select("scope").distinct(), "scope", "left_semi").join(fresh.select("scope", "id"), ["scope", "id"], "left_anti")


def compare_records(fresh: DataFrame, before: DataFrame) -> DataFrame:
    """Every record of ``fresh`` against the best that earlier snapshots hold, precision and detail of both kept.

    Of equal earlier values the one observed first is compared with.
    """
    spread = lambda rows: rows.select("scope", "generated", F.col("id").alias("snapshot"), F.inline("records"))
    first = F.row_number().over(W.partitionBy("scope", "id").orderBy(F.desc("value"), "generated", "snapshot"))
    prior = spread(before).withColumn("_r", first).where("_r = 1").select(
        "scope", "id", *[F.col(c).alias(f"prior_{c}") for c in ("value", "achieved", "precision", "detail")])
    value, old = F.col("value"), F.col("prior_value")
    status = (
        F.when(old.isNull(), "baseline").when(value > old, "broken")
        .when((value == old) & ~F.col("achieved").eqNullSafe(F.col("prior_achieved")), "tied")
        .when(value == old, "standing").otherwise("historic"))
    return spread(fresh).join(prior, ["scope", "id"], "left").select(
        "scope", "snapshot", "id", "value", "achieved", "precision", "detail", "format", status.alias("status"),
        F.round(value - old, 6).alias("delta"), "prior_value", "prior_achieved", "prior_precision", "prior_detail")


def leading_model(models: Column) -> Column:
    """The model with most volume above none; ties by name."""
    entries = F.filter(F.map_entries(models), lambda e: e["value"] > 0)
    return F.array_min(F.transform(entries, lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))["k"]


def stories(fresh: DataFrame, history: DataFrame, named: int = 4) -> DataFrame:
    """One row per snapshot of ``fresh``: what changed against the stored history of its scope.

    A first observation only seals a baseline and claims no change. ``season_known`` says that the latest season was
    stored as it is now; ``season_before`` names the stored season with the same first day, that is the same season
    at its earlier length.
    """
    before = earlier(history, fresh)
    last = F.row_number().over(W.partitionBy("scope").orderBy(F.desc("generated"), F.desc("id")))
    previous = before.withColumn("_r", last).where("_r = 1").select(
        "scope", F.col("id").alias("previous_id"), F.col("generated").alias("previous_generated"), F.col("last_day").alias("previous_last_day"),
        F.col("tokens").alias("_tokens"), leading_model(F.col("models")).alias("model_before"), F.col("seasons").alias("_seasons"))
    broken = compare_records(fresh, before).where("status = 'broken'").groupBy("scope").agg(
        F.count(F.lit(1)).alias("records_broken"), F.slice(F.array_sort(F.collect_list("id")), 1, named).alias("broken"))
    seen = history.select("scope", "id").distinct().withColumn("is_duplicate", F.lit(True))
    rows = fresh.join(previous, "scope", "left").join(broken, "scope", "left").join(seen, ["scope", "id"], "left")
    latest = F.element_at("seasons", -1)
    now, delta = leading_model(F.col("models")), F.col("tokens") - F.col("_tokens")
    first = F.col("previous_id").isNull()
    told = lambda c: F.when(~first, c)
    has = F.size("seasons") > 0
    chained = F.filter("_seasons", lambda s: s["start"] == F.get("seasons", F.size("seasons") - 1)["start"])
    return rows.select(
        "scope", "id", "generated", first.alias("is_baseline"), F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"),
        "previous_id", "previous_generated", "previous_last_day",
        told(delta).alias("delta"), told(F.round(F.try_divide(delta, F.col("_tokens")), 6)).alias("ratio"),
        told(F.when(delta == 0, "level").when(delta > 0, "rise").otherwise("narrower")).alias("tide"),
        told(F.coalesce("records_broken", F.lit(0).cast("bigint"))).alias("records_broken"),
        told(F.array_join(F.coalesce("broken", F.array().cast("array<string>")), ",")).alias("broken"),
        told(F.col("model_before")).alias("model_before"), now.alias("model_now"),
        told(F.coalesce(F.col("model_before") != now, F.lit(False))).alias("model_changed"),
        F.when(has, latest["id"]).alias("season_id"),
        told(has & F.exists("_seasons", lambda s: s["id"] == F.get("seasons", F.size("seasons") - 1)["id"])).alias("season_known"),
        told(F.get(chained, F.lit(0))["id"]).alias("season_before"))
