"""Projects, sessions and their relations to models.

Entities are high-cardinality, so they stay in long form and every buffer of the first
aggregation is a primitive. Lists are cut by top-k operators, never by collecting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.functions import calendar as cal
from tidemeter.functions import labels
from tidemeter.functions.volumes import share, zero
from tidemeter.operators.periods import dominant
from tidemeter.operators.registry import fold

# List lengths.
TOP_ENTITIES = 6
TOP_BY = 8
FLOW_LIMITS = (7, 7, 8)


def entity_cube(
    rec: DataFrame, kind: str, keys: Sequence[str] = ("day", "entity", "model"),
    slots: DataFrame | None = None, grain: str | None = None,
) -> DataFrame:
    """Totals, turns and first active day of records that carry a project or session.

    Like the usage cube, it groups by the keys a query needs: any of day, period (of
    ``grain``), entity and model. Seats are looked up before the reduction (a seven-row
    broadcast), so entity rows are shuffled once and not again after folding.
    """
    named = rec.where(F.col(kind) != "").select(
        "day", F.col(kind).alias("entity"), labels.model_or_unknown(F.col("model")).alias("model"), "total")
    if slots is not None and "model" in keys:
        named = fold(named, slots)
    if grain is not None:
        named = named.withColumn("period", cal.period_start(F.col("day"), grain))
    return named.groupBy(*keys).agg(
        F.sum(zero(F.col("total"))).alias("total"), F.count(F.lit(1)).alias("calls"),
        F.min(F.when(F.col("total") > 0, F.col("day"))).alias("first_day"))


def top_by(rec: DataFrame, column: str, limit: int = TOP_BY) -> DataFrame:
    """Largest values of one record column; empty values are skipped."""
    return (
        rec.where(F.col(column) != "")
        .groupBy(F.col(column).alias("member"))
        .agg(F.sum(zero(F.col("total"))).alias("total"))
        .orderBy(F.desc("total"), "member").limit(limit)
    )


def entity_model(days: DataFrame) -> DataFrame:
    """(entity, model) totals over the range."""
    return days.groupBy("entity", "model").agg(F.sum("total").alias("total"), F.sum("calls").alias("calls"))


def entity_totals(days: DataFrame) -> DataFrame:
    return days.groupBy("entity").agg(F.sum("total").alias("total"), F.sum("calls").alias("calls"))


def entity_pass(days: DataFrame) -> DataFrame:
    """What running metrics and distributions need of one kind of entity, from its cube by day, in one exchange by entity.

    Each entity's days are walked once, in order: turns and total so far, its first and its last day. Two kinds of
    row come out, summed before they are shuffled: ``part`` ``day`` has, by day, the number of entities first seen
    (``fresh``) and the most turns that any had reached (``best``); ``part`` ``total`` has the number of entities
    (``n``) of each total (``value``). Days up to any day are right for the range that ends there.
    """
    walk = W.partitionBy("entity").orderBy("day")
    so_far = walk.rowsBetween(W.unboundedPreceding, 0)
    rows = days.select(
        "day", F.sum("calls").over(so_far).alias("turns"), F.sum("total").over(so_far).alias("reached"),
        F.row_number().over(walk).alias("_n"), F.lead("day").over(walk).isNull().alias("_last"))
    none = lambda kind: F.lit(None).cast(kind)
    by_day = F.struct(
        F.lit("day").alias("part"), F.col("day"), none("bigint").alias("value"),
        (F.col("_n") == 1).cast("bigint").alias("fresh"), F.col("turns").alias("best"), none("bigint").alias("n"))
    at_end = F.struct(
        F.lit("total").alias("part"), none("date").alias("day"), F.col("reached").alias("value"),
        none("bigint").alias("fresh"), none("bigint").alias("best"), F.lit(1).cast("bigint").alias("n"))
    both = rows.select(F.explode(F.when(F.col("_last"), F.array(by_day, at_end)).otherwise(F.array(by_day))).alias("r")).select("r.*")
    return both.groupBy("part", "day", "value").agg(
        F.sum("fresh").alias("fresh"), F.max("best").alias("best"), F.sum("n").alias("n"))


def entity_counts(rec: DataFrame) -> DataFrame:
    """Exact number of projects and sessions, longest session in turns.

    Each kind is reduced to one row per entity first, so no set is held in memory.
    """
    def one(kind: str) -> DataFrame:
        per = rec.where(F.col(kind) != "").groupBy(kind).agg(
            F.count(F.lit(1)).alias("turns"), F.sum(zero(F.col("total"))).alias("total"))
        return per.agg(
            F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("entities"),
            F.coalesce(F.max("turns"), F.lit(0).cast("bigint")).alias("max_turns"),
            F.coalesce(F.max("total"), F.lit(0).cast("bigint")).alias("max_total"),
        )

    return one("project").unionByName(one("session"))


def edges(days: DataFrame) -> DataFrame:
    """Entity to model relation totals over the range.

    Projects and sessions give two parallel relations; they are never paired.
    """
    return entity_model(days).select("entity", "model", "total")


def lead_first() -> Column:
    """Sort key of a model row: larger totals first, then the smaller name."""
    return F.struct((-F.col("total")).alias("down"), F.col("model").alias("model"))


def top_entities(entities: DataFrame, models: Sequence[str] | None = None, limit: int = TOP_ENTITIES) -> DataFrame:
    """Largest entities of the range with dominant model and model composition.

    An entity has at most one row per seated model, so its list holds eight items at most
    and one pass yields total, leader and composition together.
    """
    chosen = entities.where(F.col("model").isin(list(models))) if models else entities
    per = entity_model(chosen).groupBy("entity").agg(
        F.sum("total").alias("total"), F.array_sort(F.collect_list(lead_first())).alias("parts"))
    tops = per.where("total > 0").orderBy(F.desc("total"), "entity").limit(limit)
    first = F.when(-F.col("parts")[0]["down"] > 0, F.col("parts")[0])
    return tops.select(
        "entity", "total",
        F.row_number().over(W.orderBy(F.desc("total"), "entity")).cast("bigint").alias("rank"),
        first["model"].alias("dominant_model"), (-first["down"]).alias("dominant_total"),
        F.array_join(F.transform(
            "parts", lambda p: F.concat(p["model"], F.lit(":"), (-p["down"]).cast("string"))), ",").alias("composition"),
    )


def top_entities_by_day(days: DataFrame, limit: int = TOP_ENTITIES) -> DataFrame:
    """Largest entities of each day; the window group limit trims before the shuffle."""
    per = days.groupBy("day", "entity").agg(F.sum("total").alias("total"))
    ranked = per.withColumn(
        "rank", F.row_number().over(W.partitionBy("day").orderBy(F.desc("total"), "entity"))
    )
    return ranked.where(F.col("rank") <= limit).withColumn("rank", F.col("rank").cast("bigint"))


def catalogue(periods: DataFrame, everything: DataFrame) -> DataFrame:
    """Every entity with share, active periods, first day, peak period and dominant model.

    ``periods`` is (period, entity, model); ``everything`` is the one-row grand total and
    enters as a scalar subquery. Buffers stay primitive until one row per (entity, period)
    is left.
    """
    by_period = periods.groupBy("entity", "period").agg(
        F.sum("total").alias("total"), F.min("first_day").alias("first_day")).where("total > 0")
    facts = by_period.groupBy("entity").agg(
        F.sum("total").alias("total"),
        F.count(F.lit(1)).alias("active_periods"),
        F.min("first_day").alias("first_day"),
        F.max(F.struct(F.col("total").alias("v"), (-cal.day_number(F.col("period"))).alias("d"))).alias("peak"),
    )
    lead = dominant(["entity"], entity_model(periods)).select("entity", F.col("model").alias("dominant_model"))
    return facts.join(lead, "entity", "left").select(
        "entity", labels.project_label(F.col("entity")).alias("label"), "total",
        share(F.col("total"), everything.scalar()).alias("share"), "active_periods", "first_day",
        F.date_from_unix_date(-F.col("peak.d")).alias("peak_period"),
        F.col("peak.v").alias("peak_total"), "dominant_model",
    )


def entity_series(periods: DataFrame) -> DataFrame:
    """(entity, period, model) totals with activity."""
    return periods.where("total > 0").select("entity", "period", "model", "total")


def flow_slice(
    projects: DataFrame, sessions: DataFrame, limits: tuple[int, int, int] = FLOW_LIMITS
) -> DataFrame:
    """Edges among the largest models, and the largest projects and sessions within them.

    Inputs are the two edge relations; every cut is a top-k, every filter a semi join
    against at most eight rows.
    """
    n_models, n_projects, n_sessions = limits
    per = projects.select("model", "total", F.lit("p").alias("side")).unionByName(
        sessions.select("model", "total", F.lit("s").alias("side"))
    ).groupBy("model", "side").agg(F.sum("total").alias("total"))
    models = (
        per.groupBy("model").agg(F.max("total").alias("total"))
        .orderBy(F.desc("total"), "model").limit(n_models).select("model")
    )

    def side(edge: DataFrame, name: str, limit: int) -> DataFrame:
        inside = edge.where("total > 0").join(F.broadcast(models), "model", "left_semi")
        tops = (
            inside.groupBy("entity").agg(F.sum("total").alias("weight"))
            .orderBy(F.desc("weight"), "entity").limit(limit)
        )
        return inside.join(F.broadcast(tops), "entity", "left_semi").select(
            F.lit(name).alias("relation"), "entity", "model", "total"
        )

    return side(projects, "project_model", n_projects).unionByName(side(sessions, "model_session", n_sessions))


def exact_median(values: DataFrame, column: str, digits: int = 21) -> DataFrame:
    """Exact median of a non-negative bigint column, by radix selection.

    A percentile aggregate keeps every distinct value in one buffer. This walks the
    value in three 21-bit digits instead: each pass counts one digit's histogram (at
    most 2^21 rows) and narrows both middle ranks to one bucket.
    """
    return median_of(values.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")), digits)


def median_of(hist: DataFrame, digits: int = 21) -> DataFrame:
    """``exact_median`` of values ``v`` that occur ``n`` times."""
    ranks = None
    for level in (2, 1, 0):
        shift = digits * level
        bucket = F.shiftright("v", shift).alias("bucket")
        if ranks is None:
            top = hist.select(bucket, "n").groupBy("bucket").agg(F.sum("n").alias("n"))
            counted = top.withColumn("total", F.sum("n").over(W.partitionBy()))
            counts = counted.select("bucket", "n", F.explode(F.array(
                F.struct(F.lit(0).alias("which"), F.expr("(total + 1) div 2").alias("rank")),
                F.struct(F.lit(1).alias("which"), F.expr("total div 2 + 1").alias("rank")),
            )).alias("r")).select("r.*", "bucket", "n")
        else:
            rows = hist.select(F.shiftright("v", shift + digits).alias("prefix"), bucket, "n")
            counts = rows.join(F.broadcast(ranks), "prefix").groupBy("which", "rank", "bucket").agg(
                F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("which").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        ranks = counts.withColumn("upto", upto).where(
            (F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto"))
        ).select("which", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("bucket").alias("prefix"))
    return ranks.agg((F.sum("prefix") / 2).alias("median"))


def distribution(cube: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Day statistics, session statistics and densities in one row.

    ``projects`` and ``sessions`` are entity cubes by any keys that include the entity.
    """
    hist = lambda entities: entity_totals(entities).groupBy(F.col("total").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return _distribution(cube, hist(projects), hist(sessions))


def distribution_from(cube: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """``distribution`` from entity passes."""
    hist = lambda done: done.where("part = 'total'").select(F.col("value").alias("v"), "n")
    return _distribution(cube, hist(projects), hist(sessions))


def _distribution(cube: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """Projects and sessions are counted by their totals: number, maximum and median need nothing else."""
    per_day = cube.groupBy("day").agg(F.sum("total").alias("total"), F.sum("calls").alias("calls"))
    days = per_day.agg(
        F.count(F.lit(1)).alias("days"), F.sum("total").alias("total"), F.sum("calls").alias("calls"),
        F.avg("total").alias("m"), F.stddev_pop("total").alias("sd"), F.max("total").alias("day_max"),
    )

    def facts(hist: DataFrame):
        return hist.agg(F.struct(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("n"), F.max("v").alias("most"))).scalar()

    joined = days.select(
        "*", facts(sessions).alias("s"), facts(projects).alias("p"), median_of(sessions).scalar().alias("median"),
    ).select(
        "*", F.col("s.n").alias("sessions"), F.col("s.most").alias("session_max"),
        F.col("p.n").alias("projects"), F.col("p.most").alias("project_max"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 4)
    return joined.select(
        "days", "total", "calls", "sessions", "projects",
        F.round("m", 4).alias("day_mean"), "day_max",
        share(F.col("sd"), F.col("m")).alias("day_cv"),
        ratio("total", "sessions").alias("session_mean"),
        F.round("median", 4).alias("session_median"), "session_max",
        ratio("total", "projects").alias("project_mean"), "project_max",
        ratio("total", "calls").alias("volume_per_call"),
        ratio("calls", "days").alias("calls_per_day"),
        ratio("sessions", "days").alias("sessions_per_day"),
    )


def concentration(cube: DataFrame) -> DataFrame:
    """Share of the largest model and the Herfindahl index."""
    per = cube.groupBy("model").agg(F.sum("total").alias("total"))
    part = per.withColumn("p", F.try_divide("total", F.sum("total").over(W.partitionBy())))
    return part.agg(
        F.round(F.coalesce(F.max("p"), F.lit(0.0)), 6).alias("top_share"),
        F.round(F.coalesce(F.sum(F.col("p") * F.col("p")), F.lit(0.0)), 6).alias("herfindahl"),
    )
