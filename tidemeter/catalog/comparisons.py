"""Comparison and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemeter.catalog.registry import query
from tidemeter.catalog.sql import EV, LN, folded, parts
from tidemeter.functions import calendar as cal
from tidemeter.operators import compare as cp
from tidemeter.operators.periods import by_period
from tidemeter.schema import COUNTERS, PARTS

# Sums that a period roll-up of the cube carries.
_PERIOD = (*[c for c in COUNTERS if c != "total"], *PARTS)


@query("W7", f"""
WITH {LN}, x AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1),
y AS (SELECT *, lag(total) OVER (ORDER BY period) AS previous FROM x)
SELECT strftime(period, '%Y-%m-%d') AS period, total, previous, total - previous AS change,
round((total - previous) * 100 / previous, 4) AS change_pct FROM y""")
def month_over_month(t):
    rows = cp.period_change(by_period(t.cube("ln", "day"), "month").select("period", "total"))
    return rows.withColumn("period", cal.iso(F.col("period")))


def _elapsed(base, grain, cur, prev, days):
    return f"""
chg AS (SELECT cm AS model,
  CAST(coalesce(sum(total) FILTER (day >= {cur} AND day < {cur} + {days}), 0) AS BIGINT) AS current,
  CAST(coalesce(sum(total) FILTER (day >= {prev} AND day < {prev} + {days}), 0) AS BIGINT) AS previous
  FROM {base} WHERE hour IS NOT NULL AND ((day >= {cur} AND day < {cur} + {days}) OR (day >= {prev} AND day < {prev} + {days})) GROUP BY 1)"""


_OPEN_WEEK = _elapsed("evf", "week", "DATE '2024-01-29'", "DATE '2024-01-22'", 1)


@query("W8", f"""
WITH {folded('ev')}, {_OPEN_WEEK}
SELECT 'elapsed' AS mode, CAST(sum(current) AS BIGINT) AS current, CAST(sum(previous) AS BIGINT) AS previous,
round((sum(current) - sum(previous)) * 100 / sum(previous), 4) AS change_pct FROM chg""")
def open_week_delta(t):
    return cp.window_delta(cp.attribution(t.kept("ev", "day timed model", "total", "calls"), "week", "2024-01-30"))


@query("W8", f"""
WITH {folded('ln')}, x AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, CAST(sum(total) AS BIGINT) AS total FROM lnf GROUP BY 1),
y AS (SELECT total AS current, lag(total) OVER (ORDER BY period) AS previous, period FROM x)
SELECT 'full' AS mode, current, previous, round((current - previous) * 100 / previous, 4) AS change_pct FROM y ORDER BY period DESC LIMIT 1""")
def closed_month_delta(t):
    return cp.window_delta(cp.attribution(t.kept("ln", "day timed model", "total", "calls"), "month", "2010-01-01"))


@query("W9", f"""
WITH {folded('ln')}, p AS (SELECT DISTINCT CAST(date_trunc('month', day) AS DATE) AS period FROM lnf ORDER BY 1 DESC LIMIT 2),
chg AS (SELECT cm AS model, CAST(coalesce(sum(total) FILTER (date_trunc('month', day) = (SELECT max(period) FROM p)), 0) AS BIGINT) AS current,
  CAST(coalesce(sum(total) FILTER (date_trunc('month', day) = (SELECT min(period) FROM p)), 0) AS BIGINT) AS previous
  FROM lnf WHERE CAST(date_trunc('month', day) AS DATE) IN (FROM p) GROUP BY 1),
r AS (SELECT *, current - previous AS delta, row_number() OVER (ORDER BY abs(current - previous) DESC, model) AS rn FROM chg WHERE current <> previous)
SELECT least(rn, 6) AS rank, CASE WHEN rn <= 5 THEN model ELSE 'rest' END AS model, CAST(sum(current) AS BIGINT) AS current,
CAST(sum(previous) AS BIGINT) AS previous, CAST(sum(delta) AS BIGINT) AS delta FROM r GROUP BY 1, 2""")
def change_attribution(t):
    return cp.fold_changes(cp.attribution(t.kept("ln", "day timed model", "total", "calls"), "month", "2010-01-01"))


@query("W10 F9", f"""
WITH {folded('ln')}
SELECT cm AS model, CAST(coalesce(sum(total) FILTER (day >= DATE '1998-04-01'), 0) AS BIGINT) AS current,
CAST(coalesce(sum(total) FILTER (day < DATE '1998-04-01'), 0) AS BIGINT) AS previous,
CAST(coalesce(sum(total) FILTER (day >= DATE '1998-04-01'), 0) - coalesce(sum(total) FILTER (day < DATE '1998-04-01'), 0) AS BIGINT) AS delta
FROM lnf WHERE day BETWEEN DATE '1998-01-01' AND DATE '1998-06-30' GROUP BY 1""")
def interval_comparison(t):
    return cp.interval_comparison(
        t.kept("ln", "day model", "total", "calls", *_PERIOD), "month", "2001-06-15", "1998-01-01", "1998-03-01", "1998-04-01", since="1995-02-01")


@query("W11", f"""
WITH {folded('ln')}, x AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, CAST(sum(total) AS BIGINT) AS total FROM lnf GROUP BY 1),
ok AS (SELECT *, last_day(period) < DATE '2001-06-15' AND period >= DATE '1995-02-01' AS complete,
  lag(period) OVER (ORDER BY period) + INTERVAL 1 MONTH = period AS adjacent, lag(total) OVER (ORDER BY period) AS lt,
  lag(last_day(period) < DATE '2001-06-15' AND period >= DATE '1995-02-01') OVER (ORDER BY period) AS lc FROM x),
pk AS (SELECT period, total, CASE WHEN adjacent AND lc THEN lt END AS pt FROM ok WHERE complete ORDER BY total DESC, period LIMIT 1),
ins AS (SELECT l.* FROM lnf l, pk WHERE CAST(date_trunc('month', day) AS DATE) = pk.period)
SELECT 'total' AS section, strftime(period, '%Y-%m-%d') AS member, total AS value FROM pk
UNION ALL SELECT 'change', strftime(period, '%Y-%m-%d'), total - pt FROM pk
UNION ALL SELECT 'model', cm, CAST(sum(total) AS BIGINT) FROM ins GROUP BY 2 HAVING sum(total) > 0
UNION ALL (SELECT 'hour', CAST(hour AS VARCHAR), CAST(sum(total) AS BIGINT) AS v FROM ins GROUP BY hour ORDER BY v DESC, hour LIMIT 1)
UNION ALL (SELECT 'project', project, CAST(sum(total) AS BIGINT) AS v FROM ins GROUP BY 2 ORDER BY v DESC, project LIMIT 3)""")
def peak_month_profile(t):
    return cp.peak_profile(
        t.kept("ln", "day hour model", "total", "calls", *_PERIOD), t.entities("ln", "project", "period entity", "month"), "month", "2001-06-15", since="1995-02-01")


@query("W12", f"""
WITH {EV} SELECT '2024-01-01' AS period, CAST(sum(total) AS BIGINT) AS total,
CAST(round(sum(total) / 30 * 31) AS BIGINT) AS forecast, CAST(round(30 / 31 * 100) AS BIGINT) AS progress FROM ev""")
def month_forecast(t):
    return cp.month_forecast(t.cube("ev", "day"), "2024-01-30").withColumn("period", cal.iso(F.col("period")))


@query("W16", f"""
WITH {LN}, x AS (SELECT CAST(date_trunc('month', day) AS DATE) AS period, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1),
y AS (SELECT *, avg(total) OVER (ORDER BY period ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS mean FROM x)
SELECT strftime(period, '%Y-%m-%d') AS period, total, round(mean, 4) AS mean,
CASE WHEN mean IS NULL THEN 'unknown' WHEN mean = 0 AND total > 0 THEN 'warming' WHEN mean = 0 THEN 'steady'
WHEN total / mean - 1 > 0.12 THEN 'warming' WHEN total / mean - 1 < -0.12 THEN 'cooling' ELSE 'steady' END AS status
FROM y ORDER BY y.period DESC LIMIT 1""")
def usage_status(t):
    rows = cp.usage_status(by_period(t.cube("ln", "day"), "month").select("period", "total"))
    return rows.withColumn("period", cal.iso(F.col("period")))


@query("E1", f"""
WITH {folded('ln')}, x AS (SELECT cm AS id, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls FROM lnf GROUP BY 1)
SELECT 'model' AS kind, *, round(total / sum(total) OVER (), 6) AS share FROM x""")
def evidence_models(t):
    return cp.model_evidence(t.folded("ln", "model"))


@query("E1", f"""
WITH {LN}, x AS (SELECT CAST(date_trunc('week', day) AS DATE) AS period, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls FROM ln GROUP BY 1),
y AS (SELECT *, lag(total) OVER (ORDER BY period) AS p FROM x)
SELECT 'period' AS kind, strftime(period, '%Y-%m-%d') AS id, total, calls, total - p AS change, round((total - p) * 100 / p, 4) AS change_pct FROM y""")
def evidence_periods(t):
    return cp.period_evidence(t.cube("ln", "day"), "week")


def _entity_evidence(kind, base):
    return f"""
WITH {folded(base)}, x AS (SELECT {kind} AS id, cm, CAST(sum(total) AS BIGINT) AS v FROM {base}f WHERE {kind} <> '' GROUP BY 1, 2 HAVING sum(total) > 0),
d AS (SELECT id, cm, row_number() OVER (PARTITION BY id ORDER BY v DESC, cm) AS rn FROM x)
SELECT '{kind}' AS kind, x.id, CAST(sum(v) AS BIGINT) AS total, round(sum(v) / (SELECT sum(total) FROM {base}f), 6) AS share,
count(*) AS components, any_value(d.cm) AS dominant_model FROM x JOIN d ON x.id = d.id AND d.rn = 1 GROUP BY x.id"""


@query("E1", _entity_evidence("project", "ln"))
def evidence_projects(t):
    return cp.entity_evidence("project", t.entities("ln", "project"), t.cube("ln", "model"))


@query("E1", _entity_evidence("session", "ev"))
def evidence_sessions(t):
    return cp.entity_evidence("session", t.entities("ev", "session"), t.cube("ev", "model"))


@query("E2", f"""
WITH {EV}, x AS (SELECT CAST(coalesce(sum(total) FILTER (model = 'click'), 0) AS BIGINT) AS pinned,
CAST(coalesce(sum(total) FILTER (model = 'purchase'), 0) AS BIGINT) AS peeked FROM ev)
SELECT pinned, peeked, peeked - pinned AS delta, round((peeked - pinned) / pinned, 6) AS ratio FROM x""")
def compare_two_models(t):
    return cp.compare(cp.model_evidence(t.folded("ev", "model")), ("model", "click"), ("model", "purchase"))


@query("E3", f"""
WITH {folded('ev')}, x AS (SELECT cm AS model, CAST(coalesce(sum(total) FILTER (day >= DATE '2024-01-22'), 0) AS BIGINT) AS total,
count(*) FILTER (day >= DATE '2024-01-22') AS calls, CAST(coalesce(sum(total) FILTER (day < DATE '2024-01-22'), 0) AS BIGINT) AS previous
FROM evf WHERE day BETWEEN DATE '2024-01-15' AND DATE '2024-01-28' GROUP BY 1)
SELECT *, total - previous AS delta FROM x""")
def scope_summary(t):
    return cp.scope_summary(t.kept("ev", "day model", "total", "calls"), "week", "2024-01-22")


@query("E4", f"""
WITH {folded('ev')}, {parts('evf')}, m AS (SELECT * FROM pt WHERE cm = 'click')
SELECT 'project' AS branch, project AS member, CAST(sum(total) AS BIGINT) AS total FROM m WHERE project <> '' GROUP BY 2 HAVING sum(total) <> 0
UNION ALL SELECT 'session', session, CAST(sum(total) AS BIGINT) FROM m WHERE session <> '' GROUP BY 2 HAVING sum(total) <> 0
UNION ALL SELECT 'composition', 'fresh_part', CAST(sum(fresh_part) AS BIGINT) FROM m
UNION ALL SELECT 'composition', 'output_part', CAST(sum(output_part) AS BIGINT) FROM m
UNION ALL SELECT 'composition', 'read_part', CAST(sum(read_part) AS BIGINT) FROM m
UNION ALL SELECT 'composition', 'write_part', CAST(sum(write_part) AS BIGINT) FROM m
UNION ALL SELECT 'composition', 'other_part', CAST(sum(other_part) AS BIGINT) FROM m""")
def model_branches(t):
    return cp.model_branches(
        "click", t.folded("ev", "model"), t.entities("ev", "project"),
        t.entities("ev", "session"))
