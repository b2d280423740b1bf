"""Comparisons between periods, intervals and entities.

Inputs are the cube or its period roll-ups, so every unpartitioned window below runs
over calendar-sized tables. Pairs of periods are matched by equality on the period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemeter.functions import calendar as cal
from tidemeter.functions.volumes import share, share_or_null
from tidemeter.operators import entities as en
from tidemeter.operators.cube import additive
from tidemeter.operators.periods import by_period, mark_adjacent, mark_complete
from tidemeter.operators.rhythm import hourly, timed
from tidemeter.schema import PARTS

# List lengths, the status band and how many prior periods it averages.
TOP_CHANGES = 5
STATUS_BAND = 0.12
STATUS_PRIOR = 4


def _all() -> WindowSpec:
    """Frame over a whole calendar-sized table."""
    return W.partitionBy()


def with_period(cube: DataFrame, grain: str) -> DataFrame:
    return cube.withColumn("period", cal.period_start(F.col("day"), grain))


def period_models(cube: DataFrame, grain: str) -> DataFrame:
    daily = additive(cube, ["day", "model"], ["total", "calls"])
    return additive(with_period(daily, grain), ["period", "model"], ["total", "calls"])


def period_change(periods: DataFrame) -> DataFrame:
    """Change against the previous available row."""
    before = F.lag("total").over(W.orderBy("period"))
    return periods.withColumn("previous", before).withColumn(
        "change", F.col("total") - F.col("previous")
    ).withColumn("change_pct", share_or_null((F.col("total") - F.col("previous")) * 100, F.col("previous"), 4))


def window_pair(cube: DataFrame, grain: str, generated: str, until: str | None = None) -> DataFrame:
    """The last two available periods and how they may be compared: at most two rows.

    A closed period compares in full. An open week or month compares its finished days
    with as many leading days of the period before. An open day has no comparison.
    """
    totals = additive(with_period(additive(cube, ["day"], ["total"]), grain), ["period"], ["total"])
    pair = totals.orderBy(F.desc("period")).limit(2)
    now = F.lit(generated).cast("date")
    current = F.max("period").over(_all())
    is_open = now.between(current, cal.period_end(current, grain))
    if until:
        is_open = is_open & (F.lit(until).cast("date") >= now)
    elapsed = F.datediff(now, current)
    mode = F.when(~is_open, "full")
    if grain != "day":
        mode = mode.when(elapsed > 0, "elapsed")
    return pair.select(
        "period", (F.col("period") == current).alias("is_current"), mode.alias("mode"),
        elapsed.alias("elapsed"), F.count(F.lit(1)).over(_all()).alias("n"),
    ).where("n = 2 and mode is not null").drop("n")


def attribution(cube: DataFrame, grain: str, generated: str, until: str | None = None) -> DataFrame:
    """Per-model current, previous and delta over the comparable window.

    Elapsed windows sum records with a known hour only, like the hour vectors they stand for.
    """
    pair = F.broadcast(window_pair(cube, grain, generated, until))
    full = period_models(cube, grain).join(pair, "period").where("mode = 'full'").select(
        "is_current", "mode", "model", "total")
    daily = with_period(additive(timed(cube), ["day", "model"], ["total"]), grain)
    partial = daily.join(pair, "period").where(
        "mode = 'elapsed' and datediff(day, period) < elapsed").select("is_current", "mode", "model", "total")
    pick = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("total"))), F.lit(0).cast("bigint"))
    return full.unionByName(partial).groupBy("mode", "model").agg(
        pick(F.col("is_current")).alias("current"), pick(~F.col("is_current")).alias("previous")
    ).withColumn("delta", F.col("current") - F.col("previous"))


def window_delta(changes: DataFrame) -> DataFrame:
    """One row with the compared totals; none when the earlier total is not positive."""
    return changes.groupBy("mode").agg(
        F.sum("current").alias("current"), F.sum("previous").alias("previous")
    ).where("previous > 0").withColumn(
        "change_pct", share_or_null((F.col("current") - F.col("previous")) * 100, F.col("previous"), 4))


def fold_changes(changes: DataFrame, limit: int = TOP_CHANGES) -> DataFrame:
    """Largest changes first, the remainder folded into one row."""
    moved = changes.withColumn("_base", F.sum("previous").over(_all())).where("_base > 0 and delta <> 0")
    ranked = moved.withColumn("rank", F.row_number().over(W.orderBy(F.desc(F.abs("delta")), "model")))
    shown = ranked.withColumn("rank", F.least("rank", F.lit(limit + 1)).cast("bigint")).withColumn(
        "model", F.when(F.col("rank") <= limit, F.col("model")).otherwise("rest"))
    return shown.groupBy("rank", "model").agg(
        *[F.sum(c).alias(c) for c in ("current", "previous", "delta")])


def interval_comparison(
    cube: DataFrame, grain: str, generated: str, start: str, end: str, b_start: str,
    since: str | None = None, until: str | None = None,
) -> DataFrame:
    """Per-model A/B deltas of two equal-length runs of complete, adjacent periods.

    Empty when B does not follow A, does not fit, or either run has a gap.
    """
    rows = mark_complete(by_period(cube, grain).select("period", "total"), grain, generated, since, until)
    rows = mark_adjacent(rows.where("complete"), grain).withColumn(
        "i", F.row_number().over(W.orderBy("period")))
    place = lambda day: F.max(F.when(F.col("period") == F.lit(day).cast("date"), F.col("i"))).over(_all())
    rows = rows.withColumn("a1", place(start)).withColumn("a2", place(end)).withColumn("b1", place(b_start))
    rows = rows.withColumn("b2", F.expr("b1 + a2 - a1")).withColumn("n", F.max("i").over(_all()))
    side = F.when(F.expr("i between a1 and a2"), "a").when(F.expr("i between b1 and b2"), "b")
    rows = rows.withColumn("side", side).where("a2 >= a1 and b1 > a2 and b2 <= n and side is not null")
    gap = F.expr("not adjacent and i <> a1 and i <> b1")
    whole = rows.withColumn("_gaps", F.count_if(gap).over(_all())).where("_gaps = 0").select("period", "side")
    pm = period_models(cube, grain).join(whole, "period")
    pick = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("total"))), F.lit(0).cast("bigint"))
    return pm.groupBy("model").agg(pick("b").alias("current"), pick("a").alias("previous")).withColumn(
        "delta", F.col("current") - F.col("previous"))


def peak_period(cube: DataFrame, grain: str, generated: str, since=None, until=None) -> DataFrame:
    """Largest complete period (first on ties) with its adjacent complete predecessor."""
    rows = mark_adjacent(
        mark_complete(by_period(cube, grain).select("period", "total"), grain, generated, since, until), grain)
    order = W.orderBy("period")
    usable = F.col("adjacent") & F.lag("complete").over(order)
    rows = rows.withColumn("previous_total", F.when(usable, F.lag("total").over(order)))
    return rows.where("complete").orderBy(F.desc("total"), "period").limit(1).select(
        "period", "total", "previous_total")


def peak_profile(
    cube: DataFrame, projects: DataFrame, grain: str, generated: str, since=None, until=None
) -> DataFrame:
    """The peak period's total, change, model mix, busiest hour and top three projects.

    ``projects`` is a project cube by period. The peak enters each branch as the same
    scalar subquery, which Spark evaluates once.
    """
    peak = peak_period(cube, grain, generated, since, until)
    at_peak = F.col("period") == peak.select("period").scalar()
    head = peak.select(F.explode(F.array(
        F.struct(F.lit("total").alias("section"), cal.iso(F.col("period")).alias("member"), F.col("total").alias("value")),
        F.struct(F.lit("change").alias("section"), cal.iso(F.col("period")).alias("member"),
                 (F.col("total") - F.col("previous_total")).alias("value")),
    )).alias("s")).select("s.*")
    inside = with_period(cube, grain).where(at_peak)
    mix = additive(inside, ["model"], ["total"]).where("total > 0").select(
        F.lit("model").alias("section"), F.col("model").alias("member"), F.col("total").alias("value"))
    hour = hourly(inside, []).orderBy(F.desc("total"), "hour").limit(1).select(
        F.lit("hour").alias("section"), F.col("hour").cast("string").alias("member"), F.col("total").alias("value"))
    tops = projects.where(at_peak).groupBy("entity").agg(F.sum("total").alias("total")).where("total > 0").orderBy(
        F.desc("total"), "entity").limit(3).select(
        F.lit("project").alias("section"), F.col("entity").alias("member"), F.col("total").alias("value"))
    return head.unionByName(mix).unionByName(hour).unionByName(tops)


def month_forecast(cube: DataFrame, generated: str, until: str | None = None) -> DataFrame:
    """Run-rate total of the generation month, when it is the last month and not over."""
    now = F.lit(generated).cast("date")
    months = by_period(cube, "month").select("period", "total").orderBy(F.desc("period")).limit(1)
    day, days = F.dayofmonth(now), F.dayofmonth(F.last_day(now))
    ok = (F.col("period") == cal.period_start(now, "month")) & (day < days)
    if until:
        ok = ok & (F.lit(until).cast("date") >= now)
    return months.where(ok).select(
        "period", "total",
        F.round(F.col("total") / day * days).cast("bigint").alias("forecast"),
        F.round(day / days * 100).cast("bigint").alias("progress"),
    )


def usage_status(periods: DataFrame) -> DataFrame:
    """Last period against the mean of up to four before it."""
    prior = W.orderBy("period").rowsBetween(-STATUS_PRIOR, -1)
    rows = periods.select(
        "period", "total", F.avg("total").over(prior).alias("mean"),
        F.row_number().over(W.orderBy(F.desc("period"))).alias("_back"))
    ratio = F.col("total") / F.col("mean") - 1
    status = (
        F.when(F.col("mean").isNull(), "unknown")
        .when((F.col("mean") == 0) & (F.col("total") > 0), "warming")
        .when(F.col("mean") == 0, "steady")
        .when(ratio > STATUS_BAND, "warming").when(ratio < -STATUS_BAND, "cooling").otherwise("steady")
    )
    return rows.where("_back = 1").select(
        "period", "total", F.round("mean", 4).alias("mean"), status.alias("status"))


def model_evidence(cube: DataFrame) -> DataFrame:
    """Total, share and calls of every model."""
    per = additive(cube, ["model"], ["total", "calls"])
    return per.select(
        F.lit("model").alias("kind"), F.col("model").alias("id"), "total", "calls",
        share(F.col("total"), F.sum("total").over(_all())).alias("share"))


def period_evidence(cube: DataFrame, grain: str) -> DataFrame:
    """Total, calls and change of every period."""
    rows = period_change(by_period(cube, grain).select("period", "total", "calls"))
    return rows.select(
        F.lit("period").alias("kind"), cal.iso(F.col("period")).alias("id"), "total", "calls", "change", "change_pct")


def entity_evidence(kind: str, days: DataFrame, cube: DataFrame) -> DataFrame:
    """Total, share of everything, component count and dominant model of every entity."""
    per_model = en.entity_model(days).where("total > 0")
    per = per_model.groupBy("entity").agg(
        F.sum("total").alias("total"), F.count(F.lit(1)).alias("components"), F.min(en.lead_first()).alias("lead"))
    everything = cube.agg(F.sum("total")).scalar()
    return per.select(
        F.lit(kind).alias("kind"), F.col("entity").alias("id"), "total",
        share(F.col("total"), everything).alias("share"), "components", F.col("lead.model").alias("dominant_model"))


def compare(evidence: DataFrame, left: tuple[str, str], right: tuple[str, str]) -> DataFrame:
    """Delta and ratio of two members of one kind; mixed kinds are refused."""
    if left[0] != right[0]:
        raise ValueError("only members of the same kind can be compared")
    total = lambda who: F.coalesce(F.sum(F.when(F.col("id") == who, F.col("total"))), F.lit(0).cast("bigint"))
    both = evidence.where((F.col("kind") == left[0]) & F.col("id").isin(left[1], right[1])).agg(
        total(left[1]).alias("pinned"), total(right[1]).alias("peeked"))
    return both.withColumn("delta", F.col("peeked") - F.col("pinned")).withColumn(
        "ratio", share_or_null(F.col("peeked") - F.col("pinned"), F.col("pinned")))


def scope_summary(cube: DataFrame, grain: str, period: str) -> DataFrame:
    """Per-model totals and calls of one period beside the previous available period."""
    pm = period_models(cube, grain)
    target = F.lit(period).cast("date")
    pair = pm.where(F.col("period") <= target).select("period").distinct().orderBy(F.desc("period")).limit(2)
    rows = pm.join(F.broadcast(pair), "period", "left_semi").withColumn("now", F.col("period") == target)
    pick = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0).cast("bigint"))
    return rows.groupBy("model").agg(
        pick("total", F.col("now")).alias("total"), pick("calls", F.col("now")).alias("calls"),
        pick("total", ~F.col("now")).alias("previous"),
    ).withColumn("delta", F.col("total") - F.col("previous"))


def model_branches(model: str, cube: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Projects, sessions and composition of one model, side by side and never paired."""
    def branch(name: str, days: DataFrame) -> DataFrame:
        mine = days.where(F.col("model") == model)
        return mine.groupBy("entity").agg(F.sum("total").alias("total")).where("total <> 0").select(
            F.lit(name).alias("branch"), F.col("entity").alias("member"), "total")

    sums = cube.where(F.col("model") == model).agg(*[F.sum(p).alias(p) for p in PARTS])
    parts = sums.select(F.explode(F.array(*[
        F.struct(F.lit("composition").alias("branch"), F.lit(p).alias("member"), F.col(p).alias("total"))
        for p in PARTS
    ])).alias("s")).select("s.*")
    return branch("project", projects).unionByName(branch("session", sessions)).unionByName(parts)

