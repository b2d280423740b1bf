"""Totals by period, model and source, computed from the hour cube."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.functions import calendar as cal
from tidemeter.functions.volumes import share, share_or_null
from tidemeter.operators.cube import additive, in_range
from tidemeter.schema import COUNTERS, GRAINS, PARTS, SOURCES


def roll_up(daily: DataFrame, grains: Sequence[str] = GRAINS) -> DataFrame:
    """Expand day rows to ``(grain, period)``. Input is day grain, so this stays small."""
    choices = F.array(*[
        F.struct(F.lit(g).alias("grain"), cal.period_start(F.col("day"), g).alias("period"))
        for g in grains
    ])
    return daily.withColumn("_p", F.explode(choices)).select("_p.*", "*").drop("_p")


def by_period(cube: DataFrame, grain: str) -> DataFrame:
    daily = additive(cube, ["day"])
    return additive(daily.withColumn("period", cal.period_start(F.col("day"), grain)), ["period"])


def period_model(cube: DataFrame, grains: Sequence[str] = GRAINS) -> DataFrame:
    """(grain, period, model) counters, calls and composition in one pass."""
    return additive(roll_up(additive(cube, ["day", "model"]), grains), ["grain", "period", "model"])


def summary(cube: DataFrame) -> DataFrame:
    """Grand total with model and source breakdowns from one grouping-sets pass."""
    by = additive(cube, ["model", "source"], ["total", "calls", "cache_read", "cache_write"])
    agg = [F.sum(c).alias(c) for c in ("total", "calls", "cache_read", "cache_write")]
    sets = by.groupingSets([[F.col("model")], [F.col("source")], []], F.col("model"), F.col("source")).agg(
        F.grouping_id().alias("g"), *agg
    )
    return sets.select(
        F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "model").otherwise("source").alias("dimension"),
        F.coalesce("model", "source", F.lit("all")).alias("member"),
        "total", "calls", "cache_read", "cache_write",
    )


def dimension_stats(cube: DataFrame) -> DataFrame:
    """Five counters and calls per model and per source."""
    by = additive(cube, ["model", "source"])
    agg = [F.sum(c).alias(c) for c in (*COUNTERS, "calls")]
    sets = by.groupingSets([[F.col("model")], [F.col("source")]], F.col("model"), F.col("source")).agg(*agg)
    return sets.select(
        F.when(F.col("source").isNull(), "model").otherwise("source").alias("dimension"),
        F.coalesce("model", "source").alias("member"), *COUNTERS, "calls",
    )


def coverage_days(cube: DataFrame) -> DataFrame:
    return cube.agg(
        cal.iso(F.min("day")).alias("first_day"),
        cal.iso(F.max("day")).alias("last_day"),
        F.count_distinct("day").alias("days"),
    )


def window_start(mode: str, now: str, count: int) -> Column:
    """First day of a rolling report of ``count`` days, weeks or months that ends at ``now``."""
    today = F.lit(now).cast("date")
    if mode == "day":
        return F.date_sub(today, count - 1)
    if mode == "week":
        return F.date_sub(cal.period_start(today, "week"), 7 * (count - 1))
    return cal.shift_months(today, -(count - 1))


def rolling(cube: DataFrame, mode: str, now: str, count: int) -> DataFrame:
    """Rolling report window; ``all`` keeps everything."""
    return cube if mode == "all" else cube.where(F.col("day") >= window_start(mode, now, count))


def focus_row(periods: DataFrame, focus: str) -> DataFrame:
    """The row of the focus period, or the last row when it has none."""
    columns = [F.col(c) for c in periods.columns]
    key = F.struct(F.col("period") == F.lit(focus).cast("date"), F.col("period"))
    return periods.agg(F.max_by(F.struct(*columns), key).alias("r")).where("r is not null").select("r.*")


def focus_days(cube: DataFrame, grain: str, period: str) -> DataFrame:
    """Only the days of one period."""
    start = F.lit(period).cast("date")
    return cube.where(F.col("day").between(start, cal.period_end(start, grain)))


def filter_coverage(cube: DataFrame, models: Sequence[str]) -> DataFrame:
    """Selected and all volume per grain."""
    pm = period_model(cube)
    chosen = F.coalesce(F.sum(F.when(F.col("model").isin(list(models)), F.col("total"))), F.lit(0).cast("bigint"))
    return pm.groupBy("grain").agg(chosen.alias("selected"), F.sum("total").alias("everything")).withColumn(
        "covered", share(F.col("selected"), F.col("everything"))
    )


def mark_complete(
    periods: DataFrame, grain: str, generated: str, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Flag periods that lie inside the range and ended before the generation day."""
    start, end = F.col("period"), cal.period_end(F.col("period"), grain)
    ok = end < F.lit(generated).cast("date")
    if since:
        ok = ok & (start >= F.lit(since).cast("date"))
    if until:
        ok = ok & (end <= F.lit(until).cast("date"))
    return periods.withColumn("period_end", end).withColumn("complete", ok)


def mark_adjacent(periods: DataFrame, grain: str) -> DataFrame:
    """Flag periods that begin the day after the previous available period ended."""
    before = F.lag("period").over(W.orderBy("period"))
    return periods.withColumn("previous", before).withColumn(
        "adjacent", F.coalesce(F.date_add(cal.period_end(F.col("previous"), grain), 1) == F.col("period"), F.lit(False))
    )


def model_share(cube: DataFrame) -> DataFrame:
    """Per-model totals, share and rank; ties go to the smaller name."""
    totals = additive(cube, ["model"], ["total", "calls"])
    return totals.withColumn("share", share(F.col("total"), F.sum("total").over(W.partitionBy()))).withColumn(
        "rank", F.row_number().over(W.orderBy(F.desc("total"), "model")).cast("bigint")
    )


def dominant(keys: Sequence[str], rows: DataFrame, value: str = "total") -> DataFrame:
    """Largest member of ``model`` per key, smaller name on ties (input already reduced)."""
    ranked = rows.where(F.col(value) > 0).withColumn(
        "_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(value), "model"))
    )
    return ranked.where("_r = 1").drop("_r")


def top_models(cube: DataFrame, limit: int = 3) -> DataFrame:
    return additive(cube, ["model"], ["total"]).orderBy(F.desc("total"), "model").limit(limit)


def wide(period_rows: DataFrame, models: Sequence[str]) -> DataFrame:
    """One column per chosen model; the list is given, so the pivot needs no extra pass."""
    listed = list(models)
    totals = period_rows.groupBy("period").agg(
        F.sum("total").alias("total"), F.sum("calls").alias("calls"),
        *[F.coalesce(F.sum(F.when(F.col("model") == m, F.col("total"))), F.lit(0).cast("bigint")).alias(m)
          for m in listed],
    )
    return totals.select("period", "total", *[F.col(f"`{m}`") for m in listed], "calls")


def period_shares(period_rows: DataFrame) -> DataFrame:
    """Cache and output share per period, null for an empty composition."""
    sums = period_rows.groupBy("grain", "period").agg(*[F.sum(p).alias(p) for p in PARTS])
    whole = sum((F.col(p) for p in PARTS[1:]), F.col(PARTS[0]))
    return sums.select(
        "grain", "period",
        share_or_null(F.col("read_part") + F.col("write_part"), whole).alias("cache_share"),
        share_or_null(F.col("output_part"), whole).alias("output_share"),
    )


def ordered(rows: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Rank rows by any column, nulls last, time order on ties."""
    key = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return rows.withColumn("position", F.row_number().over(W.orderBy(key, "period")).cast("bigint"))


def daily_counters(
    cube: DataFrame, since: str | None = None, until: str | None = None, sources: Sequence[str] = SOURCES
) -> DataFrame:
    """Day totals of each counter with one column for each of ``sources`` and one for all the rest."""
    listed = F.coalesce(F.col("source").isin(*sources), F.lit(False))
    rows = in_range(cube, since, until)
    return rows.groupBy("day").agg(
        *[F.sum(c).alias(c) for c in ("total", "calls", "input", "output", "cache_read", "cache_write")],
        *[F.coalesce(F.sum(F.when(F.col("source") == s, F.col("total"))), F.lit(0).cast("bigint")).alias(f"{s}_total")
          for s in sources],
        F.coalesce(F.sum(F.when(~listed, F.col("total"))), F.lit(0).cast("bigint")).alias("other_total"),
    )
