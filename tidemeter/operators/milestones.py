"""Milestone ladders over metrics and matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemeter.operators import entities as en
from tidemeter.operators import rhythm as rh
from tidemeter.operators import sequence as sq
from tidemeter.operators import turns as tn
from tidemeter.operators.cube import additive

# Ladders as (metric, shape, low, high, steps), stretches in order. A log
# ladder is rounded to whole numbers; a point is a linear stretch of one step.
LADDERS = (
    ("total", "log", 1e3, 1e14, 72),
    ("max_day", "log", 1e3, 1e12, 48),
    ("streak", "linear", 1, 30, 30),
    ("streak", "linear", 35, 205, 35),
    *[("streak", "linear", v, v, 1) for v in (365, 400, 500, 600, 666, 730, 888, 1000)],
    ("active_days", "linear", 1, 30, 30),
    ("active_days", "linear", 35, 230, 40),
    *[("active_days", "linear", v, v, 1) for v in (250, 300, 365, 500, 666, 730, 888, 1000, 1500, 2000)],
    ("hours", "linear", 1, 24, 24),
    ("models", "linear", 1, 20, 20),
    *[("models", "linear", v, v, 1) for v in (25, 30, 40, 50, 60, 75, 100, 150, 200)],
    ("projects", "linear", 1, 20, 20),
    *[("projects", "linear", v, v, 1) for v in (25, 30, 40, 50, 75, 100, 150, 200, 300, 500)],
    ("sessions", "log", 1, 1e4, 48),
    ("calls", "log", 10, 1e8, 52),
    ("cache_ratio", "linear", 0.025, 0.975, 39),
    *[("cache_ratio", "linear", v, v, 1) for v in (0.98, 0.99, 0.995, 0.999)],
    ("cache_read", "log", 1e3, 1e14, 52),
    ("max_turns", "log", 5, 5e4, 42),
    ("day_mean", "log", 1e3, 1e11, 44),
    ("input", "log", 1e3, 1e14, 54),
    ("output", "log", 1e3, 1e13, 50),
    ("cache_write", "log", 1e3, 1e13, 46),
    ("volume_per_call", "log", 10, 1e8, 42),
    ("calls_per_day", "log", 1, 1e5, 38),
    ("session_mean", "log", 100, 1e10, 46),
    ("session_median", "log", 100, 1e10, 42),
    ("session_max", "log", 1e3, 1e12, 48),
    ("sessions_per_day", "log", 0.1, 1e3, 34),
    ("project_mean", "log", 1e3, 1e12, 42),
    ("project_max", "log", 1e3, 1e13, 44),
    ("night_index", "linear", 0.025, 1, 40),
    ("morning_index", "linear", 0.025, 1, 36),
    ("work_index", "linear", 0.025, 1, 36),
    ("evening_index", "linear", 0.025, 1, 34),
    ("day_cv", "linear", 0.05, 3, 36),
    ("growth_streak", "linear", 1, 30, 30),
    ("decline_streak", "linear", 1, 30, 30),
    ("momentum", "linear", 0.025, 5, 40),
    ("avg7", "log", 1e3, 1e11, 42),
    ("avg30", "log", 1e3, 1e11, 42),
    ("active_hours", "linear", 1, 24, 24),
    ("peak_hour_total", "log", 100, 1e11, 44),
    ("active_hour_mean", "log", 100, 1e10, 40),
    ("top_share", "linear", 0.05, 1, 38),
    ("herfindahl", "linear", 0.05, 1, 38),
    *[(f"source_{s}", "log", 1e3, 1e13, 36) for s in ("claude", "gemini", "codex")],
)

# Ladders that keep repeated targets, metrics with an unlock day, tier limits.
REPEATING = ("total", "max_day", "streak", "active_days", "hours", "models", "projects", "sessions",
             "calls", "cache_ratio", "cache_read", "max_turns", "day_mean")
TRACKED = ("total", "max_day", "streak", "active_days", "hours", "models", "projects", "sessions", "calls",
           "cache_read", "max_turns", "input", "output", "cache_write",
           "source_claude", "source_gemini", "source_codex")
TIERS = (("prismatic", 0.85), ("gold", 0.6), ("silver", 0.35))

# Thresholds of the cell matrices.
WEEKDAY_HOUR = (1e2, 1e3, 1e4, 1e5)
MONTH_BAND = (1e3, 1e5, 1e7, 1e9)
MODEL_BAND = (1e3, 1e5, 1e7)
HOUR = (1e2, 1e3, 1e4, 1e5, 1e6)
WEEKDAY = (1e4, 1e6, 1e8, 1e10)
MONTH = (1e5, 1e7, 1e9)

# Paired thresholds as (first metric, its steps, second metric, its steps, tier span).
COMPOUND = (
    ("total", (1e5, 1e6, 1e7, 1e8, 1e9, 1e10), "cache_ratio", (0.1, 0.3, 0.5, 0.7, 0.9), 11),
    ("streak", (3, 7, 14, 30, 60, 100), "total", (1e5, 1e6, 1e7, 1e8, 1e9), 10),
    ("models", (1, 2, 3, 5, 8, 12), "sessions", (10, 50, 100, 500, 1000), 10),
)
NEXT_GOALS = 3


def tier(rung: Column, count: Column) -> Column:
    place = F.when(count <= 1, F.lit(1.0)).otherwise(rung / F.greatest(count - 1, F.lit(1)))
    expr = F.lit("bronze")
    for name, at in reversed(TIERS):
        expr = F.when(place >= at, name).otherwise(expr)
    return expr


def tier_rank(name: Column) -> Column:
    return F.when(name == "prismatic", 3).when(name == "gold", 2).when(name == "silver", 1).otherwise(0)


def ladders(spark: SparkSession) -> DataFrame:
    """(metric, rung, target, tier, tracked), expanded from the stretch rules."""
    rules = spark.createDataFrame(
        [(m, i, shape, float(lo), float(hi), n) for i, (m, shape, lo, hi, n) in enumerate(LADDERS)],
        "metric string, stretch int, shape string, lo double, hi double, n int")
    steps = rules.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    linear = F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * at, 6)
    log = F.floor(F.col("lo") * F.pow(F.col("hi") / F.col("lo"), at) + 0.5).cast("double")
    target = F.when(F.col("shape") == "log", log).otherwise(linear)
    points = steps.select("metric", "stretch", "i", target.alias("target"))
    again = F.row_number().over(W.partitionBy("metric", "target").orderBy("stretch", "i"))
    unique = points.withColumn("_n", again).where(
        (F.col("_n") == 1) | F.col("metric").isin(list(REPEATING)))
    order = W.partitionBy("metric").orderBy("target", "stretch", "i")
    rung = (F.row_number().over(order) - 1).cast("bigint")
    count = F.count(F.lit(1)).over(W.partitionBy("metric"))
    return unique.select(
        "metric", rung.alias("rung"), "target", tier(rung, count).alias("tier"),
        F.col("metric").isin(list(TRACKED)).alias("tracked"))


def unpivot(row: DataFrame, columns: dict[str, str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Columns to (metric, value) rows; ``columns`` maps column to metric name."""
    pairs = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for c, m in columns.items()])
    return row.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*")


def running_metrics(cube: DataFrame, projects: DataFrame, sessions: DataFrame) -> DataFrame:
    """(day, metric, value) of every tracked metric, all of them non-decreasing.

    ``projects`` and ``sessions`` are entity passes (``entities.entity_pass``).
    """
    days = sq.day_totals(cube)
    running = sq.running_totals(cube)
    totals = unpivot(running, {
        **{c: c for c in ("total", "calls", "cache_read", "input", "output", "cache_write", "max_day", "active_days")},
        **{c: c for c in running.columns if c.startswith("source_")}, "longest_streak": "streak"}, ("day",))
    seen = unpivot(sq.running_distinct(days, sq.first_seen_from(cube, projects, sessions)),
                   {c: c for c in ("hours", "models", "projects", "sessions")}, ("day",))
    turns = unpivot(tn.running_max_from(cube, sessions), {"max_turns": "max_turns"}, ("day",))
    return totals.unionByName(seen).unionByName(turns)


def metric_values(cube: DataFrame, projects: DataFrame, sessions: DataFrame, generated: str) -> DataFrame:
    """(metric, value) of every laddered metric at the end of the range."""
    last = running_metrics(cube, projects, sessions).groupBy("metric").agg(F.max("value").alias("value"))
    shape = unpivot(en.distribution_from(cube, projects, sessions), {c: c for c in (
        "day_mean", "volume_per_call", "calls_per_day", "session_mean", "session_median", "session_max",
        "sessions_per_day", "project_mean", "project_max", "day_cv")})
    clock = unpivot(rh.hour_indices(cube), {c: c for c in (
        "night_index", "morning_index", "work_index", "evening_index", "active_hours", "active_hour_mean",
        "peak_hour_total")})
    trend = unpivot(sq.trend(sq.day_totals(cube), generated), {c: c for c in (
        "growth_streak", "decline_streak", "momentum", "avg7", "avg30")}).withColumn(
        "value", F.greatest("value", F.lit(0.0)))
    focus = unpivot(en.concentration(cube), {c: c for c in ("top_share", "herfindahl")})
    cache = unpivot(additive(cube, [], ["cache_read", "total"]).select(
        F.round(F.coalesce(F.try_divide("cache_read", "total"), F.lit(0.0)), 6).alias("cache_ratio")),
        {"cache_ratio": "cache_ratio"})
    out = last
    for part in (shape, clock, trend, focus, cache):
        out = out.unionByName(part)
    return out


def goals(values: DataFrame) -> DataFrame:
    """Every rung with its progress. The ladder is a fixed table, so it is broadcast."""
    rungs = F.broadcast(ladders(values.sparkSession))
    ratio = F.when(F.col("target") > 0, F.least(F.greatest(F.col("value") / F.col("target"), F.lit(0.0)), F.lit(1.0)))
    return values.join(rungs, "metric").select(
        "metric", "rung", "target", "tier", "tracked", "value",
        (F.col("value") >= F.col("target")).alias("met"),
        F.round(F.coalesce(ratio, (F.col("value") >= F.col("target")).cast("double")), 6).alias("progress"),
        F.round(F.greatest(F.col("target") - F.col("value"), F.lit(0.0)), 6).alias("remaining"))


def unlock_days(running: DataFrame) -> DataFrame:
    """First day each tracked rung was reached, flagged when it is the first day of the range.

    Metrics only grow, so a rung is reached on the one day that steps over it.
    """
    w = W.partitionBy("metric").orderBy("day")
    steps = running.withColumn("_before", F.lag("value").over(w)).withColumn("_first", F.min("day").over(W.partitionBy("metric")))
    rungs = F.broadcast(ladders(running.sparkSession).where("tracked"))
    hit = steps.join(rungs, "metric").where(
        (F.col("value") >= F.col("target")) & (F.col("_before").isNull() | (F.col("_before") < F.col("target"))))
    return hit.select(
        "metric", "rung", "target", "tier", "day",
        F.when(F.col("day") == F.col("_first"), "range-boundary").otherwise("range-day").alias("precision"))


def timeline(unlocked: DataFrame) -> DataFrame:
    """Best rung and number of rungs crossed per metric and day."""
    key = F.struct(tier_rank(F.col("tier")).alias("a"), F.col("target").alias("b"), F.col("rung").alias("c"))
    return unlocked.groupBy("metric", "day").agg(
        F.max_by(F.struct("rung", "target", "tier"), key).alias("best"), F.count(F.lit(1)).alias("crossed")
    ).select("metric", "day", "best.*", "crossed")


def next_goals(all_goals: DataFrame, limit: int = NEXT_GOALS) -> DataFrame:
    """Nearest unmet rung of each tracked metric, the closest ones first."""
    nearest = all_goals.where("tracked and not met").groupBy("metric").agg(
        F.min_by(F.struct("rung", "target", "tier", "value", "progress", "remaining"),
                 F.struct("target", "rung")).alias("g")).select("metric", "g.*")
    return nearest.orderBy(F.desc("progress"), F.desc(tier_rank(F.col("tier"))), "target", "metric").limit(limit)


def newly_unlocked(now: DataFrame, before: DataFrame) -> DataFrame:
    """Unlocked ids that were not unlocked at the previous snapshot."""
    return now.join(before.select("metric", "rung"), ["metric", "rung"], "left_anti")


def _cells(rows: DataFrame, matrix: str, cell: Column, thresholds: tuple[float, ...]) -> DataFrame:
    targets = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("rung"), F.lit(float(v)).alias("target"))
        for i, v in enumerate(thresholds)])
    return rows.select(F.lit(matrix).alias("matrix"), cell.alias("cell"), "total", F.explode(targets).alias("t")).select(
        "matrix", "cell", "t.*", "total", (F.col("total") >= F.col("t.target")).alias("met"),
        tier(F.col("t.rung"), F.lit(len(thresholds))).alias("tier"))


def _full(rows: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """All cells of a fixed grid, zero where nothing was observed."""
    return spine.join(rows, keys, "left").withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))


def matrix_milestones(cube: DataFrame) -> DataFrame:
    """Thresholds on weekday x hour, month x band, model x band, hour, weekday and month."""
    spark = cube.sparkSession
    b = [name for name, _, _ in rh.BANDS]
    names = F.element_at(F.array(*[F.lit(x) for x in b]), (F.col("id") % 4 + 1).cast("int"))
    wh = spark.range(168).select(F.expr("id div 24").alias("weekday"), (F.col("id") % 24).alias("hour"))
    mb = spark.range(48).select((F.expr("id div 4") + 1).alias("month"), names.alias("band"))
    hours = spark.range(24).select(F.col("id").alias("hour"))
    weekdays = spark.range(7).select(F.col("id").alias("weekday"))
    months = spark.range(12).select((F.col("id") + 1).alias("month"))
    model_spine = cube.select("model").distinct().select("model", F.explode(F.array(*[F.lit(x) for x in b])).alias("band"))
    parts = (
        _cells(_full(rh.weekday_hour(cube), wh, ["weekday", "hour"]), "weekday_hour",
               F.concat_ws("/", "weekday", "hour"), WEEKDAY_HOUR),
        _cells(_full(rh.month_band(cube), mb, ["month", "band"]), "month_band",
               F.concat_ws("/", "month", "band"), MONTH_BAND),
        _cells(_full(rh.model_band(cube), model_spine, ["model", "band"]), "model_band",
               F.concat_ws("/", "model", "band"), MODEL_BAND),
        _cells(_full(rh.hourly(cube, []), hours, ["hour"]), "hour", F.col("hour").cast("string"), HOUR),
        _cells(_full(rh.weekday_totals(cube), weekdays, ["weekday"]), "weekday", F.col("weekday").cast("string"), WEEKDAY),
        _cells(_full(rh.month_totals(cube), months, ["month"]), "month", F.col("month").cast("string"), MONTH),
    )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def compound_milestones(values: DataFrame) -> DataFrame:
    """Pairs of thresholds that both have to hold. The values become one row first."""
    names = sorted({m for a, _, b, _, _ in COMPOUND for m in (a, b)})
    row = values.agg(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names])
    grids = []
    for first, xs, second, ys, span in COMPOUND:
        grids += [F.struct(
            F.lit(f"{first}+{second}").alias("pair"), F.lit(float(x)).alias("first_target"),
            F.lit(float(y)).alias("second_target"), F.lit(i + j).cast("bigint").alias("step"),
            F.lit(span).alias("span"), F.col(first).alias("x"), F.col(second).alias("y"))
            for i, x in enumerate(xs) for j, y in enumerate(ys)]
    cells = row.select(F.explode(F.array(*grids)).alias("c")).select("c.*")
    return cells.select(
        "pair", "first_target", "second_target", tier(F.col("step"), F.col("span")).alias("tier"),
        ((F.col("x") >= F.col("first_target")) & (F.col("y") >= F.col("second_target"))).alias("met"))
