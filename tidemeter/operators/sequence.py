"""Ordered analytics over day and period tables.

Raw records are reduced to day grain first; unpartitioned windows only ever see one row
per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from tidemeter.functions import calendar as cal
from tidemeter.operators.cube import additive
from tidemeter.schema import SOURCES

# Token milestones and trend lengths.
MILESTONES = tuple(10**n for n in range(3, 13))
SHORT, LONG = 7, 30


def _time() -> WindowSpec:
    return W.orderBy("day")


def _so_far() -> WindowSpec:
    return _time().rowsBetween(W.unboundedPreceding, 0)


def day_totals(cube: DataFrame) -> DataFrame:
    return additive(cube, ["day"], ["total", "calls", "input", "output", "cache_read", "cache_write"])


def islands(days: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Runs of consecutive active days: one row per run."""
    keys = keys or []
    active = days.where("total > 0")
    rn = F.row_number().over(W.partitionBy(*keys).orderBy("day"))
    tagged = active.withColumn("_i", F.date_sub(F.col("day"), rn))
    return tagged.groupBy(*keys, "_i").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count(F.lit(1)).alias("length")
    ).drop("_i")


def streaks(days: DataFrame, end: str) -> DataFrame:
    """Streak that ends on the snapshot day, longest streak (first one on ties)."""
    runs = islands(days)
    last = F.lit(end).cast("date")
    return runs.agg(
        F.coalesce(F.max(F.when((F.col("end") == last), F.col("length"))), F.lit(0).cast("bigint")).alias("current"),
        F.coalesce(F.max("length"), F.lit(0).cast("bigint")).alias("longest"),
        F.max_by("end", F.struct("length", -cal.day_number(F.col("end")))).alias("longest_end"),
    )


def quiet_tail(days: DataFrame, end: str) -> DataFrame:
    """Days without activity at the end of the range."""
    last = F.lit(end).cast("date")
    seen = days.where("total > 0").agg(F.max("day").alias("latest"))
    gap = F.greatest(F.datediff(last, F.col("latest")), F.lit(0)).cast("bigint")
    return seen.select(
        F.when(F.col("latest").isNull(), "none").when(gap == 0, "active").otherwise("quiet").alias("state"),
        F.coalesce(gap, F.lit(0).cast("bigint")).alias("quiet_days"),
    )


def dense(days: DataFrame, first: Column | None, last: str) -> DataFrame:
    """Calendar spine left-joined to day totals; missing days are zero."""
    start = first if first is not None else F.min("day")
    bounds = days.agg(F.to_date(start).alias("a"), F.lit(last).cast("date").alias("b")).where("a <= b")
    spine = bounds.select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days.select("day", "total"), "day", "left").select(
        "day", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))


def trend(days: DataFrame, generated: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Short and long averages, momentum and growth or decline run, open day excluded."""
    is_open = until is None or until >= generated
    anchor = generated if is_open else until
    last = F.date_sub(F.lit(anchor).cast("date"), 1 if is_open else 0)
    closed = days.where(F.col("day") <= last)
    first = F.lit(since).cast("date") if since else F.min("day")
    bounds = closed.agg(F.to_date(first).alias("a")).select("a", last.alias("b")).where("a <= b")
    spine = bounds.select(F.explode(F.sequence("a", "b")).alias("day"))
    rows = spine.join(closed.select("day", "total"), "day", "left").select(
        "day", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))
    step = F.signum((F.col("total") - F.lag("total").over(_time())).cast("double"))
    rows = rows.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn(
        "back", F.row_number().over(W.orderBy(F.desc("day"))))
    mean = lambda lo, hi: F.avg(F.when(F.col("back").between(lo, hi), F.col("total")))
    run = lambda sign: F.coalesce(
        F.min(F.when(F.col("step") != sign, F.col("back"))) - 1, F.lit(0)).cast("bigint")
    out = rows.agg(
        F.count(F.lit(1)).alias("complete_days"),
        mean(1, SHORT).alias("avg7"), mean(1, LONG).alias("avg30"), mean(SHORT + 1, 2 * SHORT).alias("prior7"),
        run(1.0).alias("growth_streak"), run(-1.0).alias("decline_streak"),
    )
    momentum = F.when((F.col("complete_days") >= 2 * SHORT) & (F.col("prior7") > 0),
                      F.col("avg7") / F.col("prior7") - 1).otherwise(0.0)
    return out.select(
        "complete_days", F.round(F.coalesce("avg7", F.lit(0.0)), 4).alias("avg7"),
        F.round(F.coalesce("avg30", F.lit(0.0)), 4).alias("avg30"),
        F.round(momentum, 6).alias("momentum"), "growth_streak", "decline_streak")


def first_seen(cube: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """(kind, day, fresh): members of each kind first seen on that day.

    Counting first days and summing them replaces a running distinct count. The entity
    cubes are by day.
    """
    out = _calendar_firsts(cube)
    for kind, entities in (("projects", projects), ("sessions", sessions)):
        firsts = entities.groupBy("entity").agg(F.min("day").alias("day"))
        out = out.unionByName(
            firsts.groupBy("day").agg(F.count(F.lit(1)).alias("fresh")).select(F.lit(kind).alias("kind"), "day", "fresh"))
    return out


def first_seen_from(cube: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """``first_seen`` from entity passes."""
    out = _calendar_firsts(cube)
    for kind, done in (("projects", projects), ("sessions", sessions)):
        out = out.unionByName(done.where("part = 'day' and fresh > 0").select(F.lit(kind).alias("kind"), "day", "fresh"))
    return out


def _calendar_firsts(cube: DataFrame) -> DataFrame:
    hours = additive(cube.where("hour is not null"), ["day", "hour"], ["total"]).where("total <> 0").select(
        F.lit("hours").alias("kind"), F.col("hour").cast("string").alias("member"), "day")
    models = additive(cube, ["day", "model"], ["total"]).where("total <> 0").select(
        F.lit("models").alias("kind"), F.col("model").alias("member"), "day")
    small = hours.unionByName(models).groupBy("kind", "member").agg(F.min("day").alias("day"))
    return small.groupBy("kind", "day").agg(F.count(F.lit(1)).alias("fresh"))


def running_distinct(days: DataFrame, firsts: DataFrame) -> DataFrame:
    """Running number of distinct hours, models, projects and sessions by day."""
    kinds = ("hours", "models", "projects", "sessions")
    wide = firsts.groupBy("day").agg(*[
        F.sum(F.when(F.col("kind") == k, F.col("fresh"))).alias(k) for k in kinds])
    rows = days.select("day").join(wide, "day", "left")
    return rows.select("day", *[
        F.coalesce(F.sum(k).over(_so_far()), F.lit(0).cast("bigint")).alias(k) for k in kinds])


def source_running_totals(cube: DataFrame) -> DataFrame:
    """Total and running total of every source there is, by day; one window per source."""
    named = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("unknown"))
    per = cube.withColumn("source", named).groupBy("day", "source").agg(F.sum("total").alias("total"))
    so_far = W.partitionBy("source").orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per.select("day", "source", "total", F.sum("total").over(so_far).alias("running"))


def running_totals(cube: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """Running sums by day, with active days, best day and longest streak so far.

    One column for each of ``sources``, and ``source_other`` for all the rest.
    """
    per_source = [
        F.coalesce(F.sum(F.when(F.col("source") == s, F.col("total"))), F.lit(0).cast("bigint")).alias(f"source_{s}")
        for s in sources]
    listed = F.coalesce(F.col("source").isin(*sources), F.lit(False))
    per_source.append(F.coalesce(F.sum(F.when(~listed, F.col("total"))), F.lit(0).cast("bigint")).alias("source_other"))
    sums = ("total", "calls", "cache_read", "input", "output", "cache_write")
    days = cube.groupBy("day").agg(*[F.sum(c).alias(c) for c in sums], *per_source)
    active = F.col("total") > 0
    rank = F.sum(active.cast("int")).over(_so_far())
    rows = days.withColumn("_rank", rank).withColumn(
        "_island", F.when(active, F.date_sub(F.col("day"), F.col("_rank").cast("int"))))
    length = F.when(active, F.row_number().over(W.partitionBy("_island").orderBy("day")))
    rows = rows.withColumn("_length", length)
    running = [*sums, *(f"source_{s}" for s in (*sources, "other"))]
    return rows.select(
        "day", *[F.sum(c).over(_so_far()).alias(c) for c in running],
        F.greatest(F.max("total").over(_so_far()), F.lit(0).cast("bigint")).alias("max_day"),
        F.col("_rank").cast("bigint").alias("active_days"),
        F.coalesce(F.max("_length").over(_so_far()), F.lit(0)).cast("bigint").alias("longest_streak"))


def milestone_crossings(days: DataFrame) -> DataFrame:
    """Every power of ten the running total passes, with its day."""
    running = days.select("day", F.sum("total").over(_so_far()).alias("reached"), "total")
    goals = F.filter(
        F.array(*[F.lit(m).cast("bigint") for m in MILESTONES]),
        lambda g: (g > F.col("reached") - F.col("total")) & (g <= F.col("reached")))
    return running.select("day", "reached", F.explode(goals).alias("milestone"))


def latest_milestone(crossings: DataFrame) -> DataFrame:
    return crossings.orderBy(F.desc("day"), F.desc("milestone")).limit(1)


def daily_leader(cube: DataFrame) -> DataFrame:
    """Every observed day with its unique largest model; null when none or tied."""
    per = additive(cube, ["day", "model"], ["total"])
    best = F.max("total").over(W.partitionBy("day"))
    marked = per.withColumn("_top", (F.col("total") == best) & (F.col("total") > 0))
    lead = F.when(F.count_if("_top") == 1, F.max(F.when(F.col("_top"), F.col("model"))))
    return marked.groupBy("day").agg(lead.alias("leader"))


def relays(leaders: DataFrame) -> DataFrame:
    """Days whose leader differs from the leader of the calendar day before."""
    rows = leaders.select(
        "day", "leader", F.lag("leader").over(_time()).alias("before"), F.lag("day").over(_time()).alias("_d"))
    return rows.where("before is not null and leader is not null and before <> leader and datediff(day, _d) = 1").select(
        "day", F.col("before").alias("from_model"), F.col("leader").alias("to_model"))


def first_observed(entities: DataFrame) -> DataFrame:
    """First day each entity shows activity."""
    return entities.groupBy("entity").agg(F.min("first_day").alias("day")).where("day is not null")


def newest_entity(firsts: DataFrame) -> DataFrame:
    return firsts.orderBy(F.desc("day"), "entity").limit(1)


def moments(cube: DataFrame, projects: DataFrame, grain: str) -> DataFrame:
    """Latest milestone, newest project and latest relay, merged by period."""
    milestone = latest_milestone(milestone_crossings(day_totals(cube))).select(
        F.lit("milestone").alias("kind"), "day", F.col("milestone").cast("string").alias("label"))
    project = newest_entity(first_observed(projects)).select(
        F.lit("project").alias("kind"), "day", F.col("entity").alias("label"))
    relay = relays(daily_leader(cube)).orderBy(F.desc("day")).limit(1).select(
        F.lit("relay").alias("kind"), "day", F.concat_ws(" > ", "from_model", "to_model").alias("label"))
    events = milestone.unionByName(project).unionByName(relay)
    merged = events.groupBy(cal.period_start(F.col("day"), grain).alias("period")).agg(
        F.array_sort(F.collect_list(F.struct("day", "kind", "label"))).alias("events"))
    return merged.select(
        "period", F.size("events").cast("bigint").alias("events"), F.element_at("events", -1)["day"].alias("day"),
        F.array_join(F.transform("events", lambda e: F.concat(e["kind"], F.lit("="), e["label"])), "; ").alias("label"))
