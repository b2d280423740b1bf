"""Period reports, filters, totals and model identities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemeter.catalog.registry import query
from tidemeter.catalog.sql import EV, LN, folded, grains, parts
from tidemeter.functions import calendar as cal
from tidemeter.operators import cube as c
from tidemeter.operators import periods as p
from tidemeter.operators import registry as r
from tidemeter.schema import COUNTERS, PARTS

SUMS = ", ".join(f"CAST(sum({x}) AS BIGINT) AS {x}" for x in ("total", "calls"))


@query("T3 J2 A5 W7", f"""
WITH {folded('ev')},
w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS period, cm AS model,
        CAST(sum(total) AS BIGINT) AS total, count(*) AS calls FROM evf GROUP BY 1, 2)
SELECT strftime(period, '%Y-%m-%d') AS period, model, total, calls,
  total - lag(total) OVER (PARTITION BY model ORDER BY period) AS change FROM w""")
def weekly_model_change(t):
    from pyspark.sql import Window as W

    weekly = p.period_model(t.folded("ev", "day model"), ["week"])
    before = F.lag("total").over(W.partitionBy("model").orderBy("period"))
    return weekly.select(
        cal.iso(F.col("period")).alias("period"), "model", "total", "calls",
        (F.col("total") - before).alias("change"),
    )


@query("F1 F2", f"""
WITH {LN} SELECT source, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls FROM ln
WHERE day BETWEEN DATE '1997-03-01' AND DATE '1999-09-30' AND source IN ('claude', 'codex') GROUP BY 1""")
def range_and_source_filter(t):
    rows = c.from_sources(c.in_range(t.rec("ln"), "1997-03-01", "1999-09-30"), ["claude", "codex"])
    return c.additive(c.usage_cube(rows, ["source"]), ["source"], ["total", "calls"])


@query("F3", f"""
WITH {EV} SELECT strftime(date_trunc('week', day), '%Y-%m-%d') AS period,
  CAST(sum(total) AS BIGINT) AS total, count(*) AS calls FROM ev WHERE model IN ('click', 'view') GROUP BY 1""")
def model_set_filter(t):
    rows = p.by_period(c.with_models(t.cube("ev", "day model"), ["click", "view"]), "week")
    return rows.select(cal.iso(F.col("period")).alias("period"), "total", "calls")


@query("F4 X6", f"""
WITH {LN} SELECT model, CAST(sum(total) AS BIGINT) AS total, count(DISTINCT day) AS days FROM ln
WHERE day IN (SELECT CAST(unnest(generate_series(DATE '1998-02-01', DATE '1998-02-28', INTERVAL 1 DAY)) AS DATE))
GROUP BY 1""")
def period_focus(t):
    rows = p.focus_days(t.cube("ln", "day model"), "month", "1998-02-01")
    return rows.groupBy("model").agg(F.sum("total").alias("total"), F.count_distinct("day").alias("days"))


@query("F5 X5", f"""
WITH {LN},
m AS (SELECT 'month' AS mode, date_trunc('month', day) AS period, total FROM ln WHERE day >= DATE '2001-01-01'),
w AS (SELECT 'week', date_trunc('week', day), total FROM ln WHERE day >= DATE '2001-04-23'),
d AS (SELECT 'day', day, total FROM ln WHERE day >= DATE '2001-06-02'),
a AS (SELECT 'all', date_trunc('month', day), total FROM ln)
SELECT mode, strftime(period, '%Y-%m-%d') AS period, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls
FROM (FROM m UNION ALL FROM w UNION ALL FROM d UNION ALL FROM a) GROUP BY 1, 2""")
def rolling_windows(t):
    cube = t.cube("ln", "day")
    out = None
    for mode, count, grain in (("day", 14, "day"), ("week", 8, "week"), ("month", 6, "month"), ("all", 0, "month")):
        rows = p.by_period(p.rolling(cube, mode, "2001-06-15", count), grain).select(
            F.lit(mode).alias("mode"), cal.iso(F.col("period")).alias("period"), "total", "calls")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("F6", f"""
WITH {LN},
x AS (SELECT date_trunc('month', day) AS period, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls FROM ln GROUP BY 1),
f AS (SELECT 'found' AS pick, * FROM x WHERE period = DATE '1999-05-01'),
l AS (SELECT 'last' AS pick, * FROM x ORDER BY period DESC LIMIT 1)
SELECT pick, strftime(period, '%Y-%m-%d') AS period, total, calls FROM (FROM f UNION ALL FROM l)""")
def focus_rows(t):
    months = p.by_period(t.cube("ln", "day"), "month").select("period", "total", "calls")
    found = p.focus_row(months, "1999-05-01").withColumn("pick", F.lit("found"))
    last = p.focus_row(months, "2050-01-01").withColumn("pick", F.lit("last"))
    return found.unionByName(last).select("pick", cal.iso(F.col("period")).alias("period"), "total", "calls")


@query("F7", f"""
WITH {folded('ln')}
SELECT g.grain, CAST(sum(CASE WHEN cm IN ('brand-1', 'brand-2', 'other') THEN total ELSE 0 END) AS BIGINT) AS selected,
  CAST(sum(total) AS BIGINT) AS everything,
  round(sum(CASE WHEN cm IN ('brand-1', 'brand-2', 'other') THEN total ELSE 0 END) / sum(total), 6) AS covered
FROM lnf, (VALUES ('day'), ('week'), ('month')) g(grain) GROUP BY 1""")
def filter_coverage(t):
    return p.filter_coverage(t.folded("ln", "day model"), ["brand-1", "brand-2", "other"])


@query("F8 F9", f"""
WITH {LN},
x AS (SELECT CAST(date_trunc('week', day) AS DATE) AS period, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1)
SELECT strftime(period, '%Y-%m-%d') AS period, total,
  period + 6 < DATE '2001-06-15' AND period >= DATE '1996-01-03' AND period + 6 <= DATE '2001-06-30' AS complete,
  coalesce(lag(period) OVER (ORDER BY period) + 7 = period, false) AS adjacent FROM x""")
def complete_and_adjacent_weeks(t):
    weeks = p.by_period(t.cube("ln", "day"), "week").select("period", "total")
    marked = p.mark_adjacent(p.mark_complete(weeks, "week", "2001-06-15", "1996-01-03", "2001-06-30"), "week")
    return marked.select(cal.iso(F.col("period")).alias("period"), "total", "complete", "adjacent")


_SUMMARY = "CAST(sum(total) AS BIGINT) AS total, count(*) AS calls, CAST(sum(coalesce(cache_read,0)) AS BIGINT) AS cache_read, CAST(sum(coalesce(cache_write,0)) AS BIGINT) AS cache_write"


@query("A1 A4 X10", f"""
WITH {EV}, n AS (SELECT *, coalesce(model, 'unknown') AS m FROM ev)
SELECT 'model' AS dimension, m AS member, {_SUMMARY} FROM n GROUP BY 2
UNION ALL SELECT 'source', source, {_SUMMARY} FROM n GROUP BY 2
UNION ALL SELECT 'all', 'all', {_SUMMARY} FROM n""")
def usage_summary(t):
    return p.summary(t.cube("ev", "source model"))


def _by(grain):
    return f"""
WITH {LN} SELECT strftime(date_trunc('{grain}', day), '%Y-%m-%d') AS period, count(*) AS calls,
{', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in COUNTERS)} FROM ln GROUP BY 1"""


def _period_frame(t, grain):
    return p.by_period(t.cube("ln", "day"), grain).select(cal.iso(F.col("period")).alias("period"), "calls", *COUNTERS)


@query("A2", _by("day"))
def totals_by_day(t):
    return _period_frame(t, "day")


@query("A2 X4 Q13", _by("week"))
def totals_by_week(t):
    return _period_frame(t, "week")


@query("A2", _by("month"))
def totals_by_month(t):
    return _period_frame(t, "month")


@query("A5", f"""
WITH {folded('ln')}
SELECT g.grain, strftime(g.period, '%Y-%m-%d') AS period, cm AS model, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls
FROM lnf, LATERAL {grains()} g GROUP BY 1, 2, 3""")
def period_model_totals(t):
    return p.period_model(t.folded("ln", "day model")).select(
        "grain", cal.iso(F.col("period")).alias("period"), "model", "total", "calls")


@query("A6 X13", f"""
WITH {folded('ev')}, {parts('evf')}
SELECT g.grain, strftime(g.period, '%Y-%m-%d') AS period, cm AS model,
{', '.join(f'CAST(sum({x}) AS BIGINT) AS {x}' for x in PARTS)}
FROM pt, LATERAL {grains()} g GROUP BY 1, 2, 3""")
def period_model_composition(t):
    return p.period_model(t.folded("ev", "day model")).select(
        "grain", cal.iso(F.col("period")).alias("period"), "model", *PARTS)


@query("X13", f"""
WITH {EV}, {parts('ev')}
SELECT seq, {', '.join(f'CAST({x} AS BIGINT) AS {x}' for x in PARTS)} FROM pt""")
def record_composition(t):
    from tidemeter.functions.volumes import composition

    rec = t.rec("ev")
    made = composition(*[F.col(x) for x in ("source", "total", "input", "output", "cache_read", "cache_write")])
    return rec.select("seq", *[col.alias(name) for name, col in made.items()])


@query("A8", f"""
WITH {EV} SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls,
{', '.join(f'CAST(sum(coalesce({x},0)) AS BIGINT) AS {x}' for x in ('input', 'output', 'cache_read', 'cache_write'))},
{', '.join(f"CAST(coalesce(sum(total) FILTER (source='{s}'),0) AS BIGINT) AS {s}_total" for s in ('claude', 'gemini', 'codex'))},
CAST(coalesce(sum(total) FILTER (source IS NULL OR source NOT IN ('claude', 'gemini', 'codex')),0) AS BIGINT) AS other_total
FROM ev GROUP BY 1""")
def daily_counters(t):
    return p.daily_counters(t.cube("ev", "day source")).withColumn("day", cal.iso(F.col("day")))


@query("A8", f"""
WITH {folded('ev')} SELECT strftime(day, '%Y-%m-%d') AS day, cm AS model,
CAST(sum(coalesce(cache_read,0)) AS BIGINT) AS cache_read FROM evf GROUP BY 1, 2""")
def daily_cache_by_model(t):
    rows = c.additive(t.folded("ev", "day model"), ["day", "model"], ["cache_read"])
    return rows.withColumn("day", cal.iso(F.col("day")))


_STATS = ", ".join(f"CAST(sum(coalesce({x},0)) AS BIGINT) AS {x}" for x in COUNTERS) + ", count(*) AS calls"


@query("A11", f"""
WITH {folded('ln')}
SELECT 'model' AS dimension, cm AS member, {_STATS} FROM lnf GROUP BY 2
UNION ALL SELECT 'source', source, {_STATS} FROM lnf GROUP BY 2""")
def dimension_stats(t):
    return p.dimension_stats(t.folded("ln", "source model"))


@query("A12", f"""
WITH {EV} SELECT strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day,
count(DISTINCT day) AS days FROM ev""")
def coverage_days(t):
    return p.coverage_days(t.cube("ev", "day"))


@query("A15", f"""
WITH {folded('ln')}, x AS (SELECT cm AS model, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls FROM lnf GROUP BY 1)
SELECT model, total, calls, round(total / sum(total) OVER (), 6) AS share,
row_number() OVER (ORDER BY total DESC, model) AS rank FROM x""")
def model_shares(t):
    return p.model_share(t.folded("ln", "model"))


@query("A23 X16", f"""
WITH {EV} SELECT CAST(sum(coalesce(cache_read,0)) AS BIGINT) AS cache_read, CAST(sum(total) AS BIGINT) AS total,
round(sum(coalesce(cache_read,0)) / sum(total), 6) AS cache_share FROM ev""")
def cache_share(t):
    from tidemeter.functions.volumes import share

    return c.additive(t.cube("ev", "source"), [], ["cache_read", "total"]).withColumn(
        "cache_share", share(F.col("cache_read"), F.col("total")))


@query("A24", f"""
WITH {EV}, {parts('ev')}
SELECT g.grain, strftime(g.period, '%Y-%m-%d') AS period,
round(sum(read_part + write_part) / nullif(sum(t), 0), 6) AS cache_share,
round(sum(output_part) / nullif(sum(t), 0), 6) AS output_share
FROM pt, LATERAL {grains()} g GROUP BY 1, 2""")
def period_shares(t):
    return p.period_shares(p.period_model(t.cube("ev", "day model"))).withColumn("period", cal.iso(F.col("period")))


@query("T1", f"""
WITH {folded('ln')} SELECT strftime(date_trunc('month', day), '%Y-%m-%d') AS period, CAST(sum(total) AS BIGINT) AS total,
{', '.join(f'CAST(coalesce(sum(total) FILTER (cm = {chr(39)}{m}{chr(39)}),0) AS BIGINT) AS "{m}"' for m in ('brand-3', 'brand-7', 'other'))},
count(*) AS calls FROM lnf GROUP BY 1""")
def wide_month_table(t):
    months = p.period_model(t.folded("ln", "day model"), ["month"])
    return p.wide(months, ["brand-3", "brand-7", "other"]).withColumn("period", cal.iso(F.col("period")))


@query("T2", f"""
WITH {LN} SELECT model, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1 ORDER BY total DESC, model LIMIT 3""")
def top_models(t):
    return p.top_models(t.cube("ln", "model"))


@query("T3", f"""
WITH {folded('ln')} SELECT r.model, coalesce(s.model, 'other') AS identity, coalesce(s.slot, 7) AS slot
FROM reg0 r LEFT JOIN slots s ON r.model = s.model""")
def model_registry(t):
    return r.slot_table(t.cube("ln", "day model"))


@query("T3", f"""
WITH {folded('ev')} SELECT r.model, coalesce(s.model, 'other') AS identity, coalesce(s.slot, 7) AS slot
FROM reg0 r LEFT JOIN slots s ON r.model = s.model""")
def model_registry_events(t):
    return r.slot_table(t.cube("ev", "day model"))


@query("A14", f"""
WITH {folded('ln')} SELECT cm AS latest_backend, model AS raw_model, cm <> model AS folded FROM lnf
WHERE day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' ORDER BY day DESC, ts DESC, model DESC LIMIT 1""")
def latest_backend(t):
    return r.latest_backend(t.cube("ln", "day model"), "1996-01-01", "1999-12-31")


@query("T7", f"""
WITH {EV}, {parts('ev')}, x AS (
SELECT CAST(date_trunc('day', day) AS DATE) AS period, round(sum(read_part + write_part) / nullif(sum(t), 0), 6) AS cache_share
FROM pt GROUP BY 1)
SELECT strftime(period, '%Y-%m-%d') AS period, cache_share,
row_number() OVER (ORDER BY cache_share DESC NULLS LAST, period) AS position FROM x""")
def sorted_by_cache_share(t):
    shares = p.period_shares(p.period_model(t.cube("ev", "day model"), ["day"])).select("period", "cache_share")
    return p.ordered(shares, "cache_share").withColumn("period", cal.iso(F.col("period")))
