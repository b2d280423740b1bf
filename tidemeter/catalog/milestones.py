"""Ladder, matrix and goal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemeter.catalog.registry import query
from tidemeter.catalog.sequences import _DAY_SUMS, _DAYS, _RUN, _TREND
from tidemeter.catalog.sql import folded
from tidemeter.functions import calendar as cal
from tidemeter.operators import milestones as ms
from tidemeter.operators.cube import in_range

_TIER = """CASE WHEN CASE WHEN {n} <= 1 THEN 1.0 ELSE {i} / greatest({n} - 1, 1) END >= 0.85 THEN 'prismatic'
WHEN CASE WHEN {n} <= 1 THEN 1.0 ELSE {i} / greatest({n} - 1, 1) END >= 0.6 THEN 'gold'
WHEN CASE WHEN {n} <= 1 THEN 1.0 ELSE {i} / greatest({n} - 1, 1) END >= 0.35 THEN 'silver' ELSE 'bronze' END"""


def _entities(t, name):
    """One pass over projects and one over sessions, which all metrics read."""
    return t.passed(name, "project"), t.passed(name, "session")


_Q = lambda names: ", ".join(f"'{n}'" for n in names)
_RULES = ", ".join(
    f"('{m}', {i}, '{shape}', {float(lo)!r}, {float(hi)!r}, {n})" for i, (m, shape, lo, hi, n) in enumerate(ms.LADDERS))

_LADDER = f"""
lr(metric, stretch, shape, lo, hi, n) AS (VALUES {_RULES}),
l0 AS (SELECT metric, stretch, i, CASE shape WHEN 'log' THEN floor(CAST(lo AS DOUBLE) * pow(CAST(hi AS DOUBLE) / CAST(lo AS DOUBLE), i / greatest(n - 1, 1)) + 0.5)
  ELSE round(CAST(lo AS DOUBLE) + (CAST(hi AS DOUBLE) - CAST(lo AS DOUBLE)) * i / greatest(n - 1, 1), 6) END AS target FROM lr, LATERAL range(n) t(i)),
l1 AS (SELECT *, row_number() OVER (PARTITION BY metric, target ORDER BY stretch, i) AS dup FROM l0),
l2 AS (SELECT metric, target, row_number() OVER (PARTITION BY metric ORDER BY target, stretch, i) - 1 AS rung,
  count(*) OVER (PARTITION BY metric) AS cnt FROM l1 WHERE dup = 1 OR metric IN ({_Q(ms.REPEATING)})),
ladder AS (SELECT metric, rung, CAST(target AS DOUBLE) AS target, {_TIER.format(n='cnt', i='rung')} AS tier, metric IN ({_Q(ms.TRACKED)}) AS tracked FROM l2)"""



def _running(b: str) -> str:
    """Running metrics by day in long form as ``rm``."""
    plain = [c for c in _RUN]
    sums = ", ".join(f"sum({c}) OVER w AS {c}" for c in plain)
    kinds = ("hours", "models", "projects", "sessions")
    long = " UNION ALL ".join(
        f"SELECT day, '{name}' AS metric, CAST({col} AS DOUBLE) AS value FROM rw"
        for col, name in [(c, c) for c in plain] + [("max_day", "max_day"), ("active_days", "active_days"), ("ls", "streak")])
    seen = " UNION ALL ".join(f"SELECT day, '{k}', CAST(sum({k}) OVER (ORDER BY day) AS DOUBLE) FROM fw" for k in kinds)
    return f"""
{_DAYS.format(base=b)},
ra AS (SELECT *, CASE WHEN total > 0 THEN day - CAST(sum(CAST(total > 0 AS INTEGER)) OVER (ORDER BY day) AS INTEGER) END AS isl FROM d),
rb AS (SELECT *, CASE WHEN total > 0 THEN row_number() OVER (PARTITION BY isl ORDER BY day) END AS len FROM ra),
rw AS (SELECT day, {sums}, greatest(max(total) OVER w, 0) AS max_day, sum(CAST(total > 0 AS INTEGER)) OVER w AS active_days,
  coalesce(max(len) OVER w, 0) AS ls FROM rb WINDOW w AS (ORDER BY day)),
ff AS (SELECT 'hours' AS kind, min(day) AS day FROM {b} WHERE hour IS NOT NULL AND total <> 0 GROUP BY hour
UNION ALL SELECT 'models', min(day) FROM {b} WHERE total <> 0 GROUP BY cm
UNION ALL SELECT 'projects', min(day) FROM {b} WHERE project <> '' GROUP BY project
UNION ALL SELECT 'sessions', min(day) FROM {b} WHERE session <> '' GROUP BY session),
fw AS (SELECT d.day, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in kinds)} FROM d LEFT JOIN ff ON d.day = ff.day GROUP BY 1),
tt AS (SELECT day, max(c) AS c FROM (SELECT day, sum(n) OVER (PARTITION BY session ORDER BY day) AS c FROM
  (SELECT session, day, count(*) AS n FROM {b} WHERE session <> '' GROUP BY 1, 2)) GROUP BY 1),
rm AS ({long} UNION ALL {seen}
UNION ALL SELECT d.day, 'max_turns', CAST(coalesce(max(c) OVER (ORDER BY d.day), 0) AS DOUBLE) FROM d LEFT JOIN tt USING (day))"""


def _values(b: str, last: str) -> str:
    """End-of-range metric values in long form as ``mv``."""
    trend = _TREND.format(base=b, last=last)
    head, tail = trend.rsplit("\nSELECT ", 1)
    return f"""{_running(b)}, {head}, tr AS (SELECT {tail}),
ss AS (SELECT sum(total) AS v FROM {b} WHERE session <> '' GROUP BY session), pp AS (SELECT sum(total) AS v FROM {b} WHERE project <> '' GROUP BY project),
hh AS (SELECT hour, sum(total) AS v FROM {b} WHERE hour IS NOT NULL GROUP BY 1), mm AS (SELECT cm, sum(total) AS v FROM {b} GROUP BY 1),
dd AS (SELECT count(*) AS days, sum(total) AS total, sum(calls) AS calls, sum(cache_read) AS cr, avg(total) AS m, stddev_pop(total) AS sd FROM d),
sa AS (SELECT count(*) AS n, max(v) AS mx, median(v) AS med FROM ss), pa AS (SELECT count(*) AS n, max(v) AS mx FROM pp),
mv AS (SELECT metric, max(value) AS value FROM rm GROUP BY 1
UNION ALL SELECT 'day_mean', round(m, 4) FROM dd UNION ALL SELECT 'volume_per_call', round(total / calls, 4) FROM dd
UNION ALL SELECT 'calls_per_day', round(calls / days, 4) FROM dd UNION ALL SELECT 'session_mean', round(total / n, 4) FROM dd, sa
UNION ALL SELECT 'session_median', round(med, 4) FROM sa UNION ALL SELECT 'session_max', mx FROM sa
UNION ALL SELECT 'sessions_per_day', round(n / days, 4) FROM dd, sa UNION ALL SELECT 'project_mean', round(total / n, 4) FROM dd, pa
UNION ALL SELECT 'project_max', mx FROM pa UNION ALL SELECT 'day_cv', round(sd / m, 6) FROM dd
UNION ALL SELECT 'night_index', round(sum(v) FILTER (hour < 6 OR hour >= 22) / sum(v), 6) FROM hh
UNION ALL SELECT 'morning_index', round(sum(v) FILTER (hour BETWEEN 6 AND 10) / sum(v), 6) FROM hh
UNION ALL SELECT 'work_index', round(sum(v) FILTER (hour BETWEEN 9 AND 17) / sum(v), 6) FROM hh
UNION ALL SELECT 'evening_index', round(sum(v) FILTER (hour BETWEEN 18 AND 21) / sum(v), 6) FROM hh
UNION ALL SELECT 'active_hours', count(*) FILTER (v > 0) FROM hh UNION ALL SELECT 'active_hour_mean', round(avg(v) FILTER (v > 0), 4) FROM hh
UNION ALL SELECT 'peak_hour_total', max(v) FROM hh
UNION ALL SELECT 'growth_streak', growth_streak FROM tr UNION ALL SELECT 'decline_streak', decline_streak FROM tr
UNION ALL SELECT 'momentum', greatest(momentum, 0) FROM tr UNION ALL SELECT 'avg7', avg7 FROM tr UNION ALL SELECT 'avg30', avg30 FROM tr
UNION ALL SELECT 'top_share', round(max(v) / sum(v), 6) FROM mm
UNION ALL SELECT 'herfindahl', round(sum(p * p), 6) FROM (SELECT v / sum(v) OVER () AS p FROM mm)
UNION ALL SELECT 'cache_ratio', round(cr / total, 6) FROM dd)"""


_GOALS = """gl AS (SELECT metric, rung, target, tier, tracked, CAST(value AS DOUBLE) AS value, value >= target AS met,
round(CASE WHEN target > 0 THEN least(greatest(value / target, 0), 1) ELSE CAST(value >= target AS INTEGER) END, 6) AS progress,
round(greatest(target - value, 0), 6) AS remaining FROM mv JOIN ladder USING (metric))"""
_UNLOCK = """st AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY day) AS bf, min(day) OVER (PARTITION BY metric) AS fd FROM rm),
ul AS (SELECT metric, rung, target, tier, st.day, CASE WHEN st.day = fd THEN 'range-boundary' ELSE 'range-day' END AS precision
FROM st JOIN ladder USING (metric) WHERE tracked AND value >= target AND (bf IS NULL OR bf < target))"""


@query("C4 A18 A19 A20", f"WITH {folded('ev')}, {_values('evf', '2024-01-30')} SELECT metric, CAST(value AS DOUBLE) AS value FROM mv")
def metric_values(t):
    return ms.metric_values(t.kept("ev", "day hour source model", *_DAY_SUMS), *_entities(t, "ev"), "2024-01-31")


@query("C4 J7", f"WITH {folded('ln')}, {_values('lnf', '2001-11-04')}, {_LADDER}, {_GOALS} SELECT * FROM gl")
def milestone_progress(t):
    return ms.goals(ms.metric_values(t.kept("ln", "day hour source model", *_DAY_SUMS), *_entities(t, "ln"), "2001-11-05"))


@query("C5 J8", f"""WITH {folded('gp')}, {_running('gpf')}, {_LADDER}, {_UNLOCK}
SELECT metric, rung, target, tier, strftime(day, '%Y-%m-%d') AS day, precision FROM ul""")
def milestone_unlock_days(t):
    rows = ms.unlock_days(ms.running_metrics(t.kept("gp", "day hour source model", *_DAY_SUMS), *_entities(t, "gp")))
    return rows.withColumn("day", cal.iso(F.col("day")))


@query("C8", f"""WITH {folded('gp')}, {_running('gpf')}, {_LADDER}, {_UNLOCK},
rk AS (SELECT *, row_number() OVER (PARTITION BY metric, day ORDER BY CASE tier WHEN 'prismatic' THEN 3 WHEN 'gold' THEN 2 WHEN 'silver' THEN 1 ELSE 0 END DESC, target DESC, rung DESC) AS rn,
count(*) OVER (PARTITION BY metric, day) AS crossed FROM ul)
SELECT metric, strftime(day, '%Y-%m-%d') AS day, rung, target, tier, crossed FROM rk WHERE rn = 1""")
def milestone_timeline(t):
    rows = ms.timeline(ms.unlock_days(ms.running_metrics(t.kept("gp", "day hour source model", *_DAY_SUMS), *_entities(t, "gp"))))
    return rows.withColumn("day", cal.iso(F.col("day")))


@query("C9", f"""WITH {folded('ev')}, {_values('evf', '2024-01-30')}, {_LADDER}, {_GOALS},
nx AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY target, rung) AS rn FROM gl WHERE tracked AND NOT met)
SELECT metric, rung, target, tier, value, progress, remaining FROM nx WHERE rn = 1
ORDER BY progress DESC, CASE tier WHEN 'prismatic' THEN 3 WHEN 'gold' THEN 2 WHEN 'silver' THEN 1 ELSE 0 END DESC, target, metric LIMIT 3""")
def next_goals(t):
    return ms.next_goals(ms.goals(ms.metric_values(t.kept("ev", "day hour source model", *_DAY_SUMS), *_entities(t, "ev"), "2024-01-31")))


@query("J9 U2", f"""WITH {folded('gp')}, {_running('gpf')}, {_LADDER}, {_UNLOCK}
SELECT metric, rung, target, tier FROM ul WHERE day > DATE '2024-02-10'""")
def newly_unlocked(t):
    running = ms.running_metrics(t.kept("gp", "day hour source model", *_DAY_SUMS), *_entities(t, "gp"))
    # What a pass says of a day depends on the days before it only.
    cut = lambda df: in_range(df, None, "2024-02-10")
    earlier = ms.running_metrics(
        cut(t.kept("gp", "day hour source model", *_DAY_SUMS)), *[cut(e) for e in _entities(t, "gp")])
    return ms.newly_unlocked(ms.unlock_days(running), ms.unlock_days(earlier)).select("metric", "rung", "target", "tier")


def _matrix(name, cells, thresholds):
    values = ", ".join(f"({i}, {float(v)!r})" for i, v in enumerate(thresholds))
    return f"""SELECT '{name}' AS matrix, cell, CAST(v.rung AS BIGINT) AS rung, CAST(v.target AS DOUBLE) AS target, CAST(total AS BIGINT) AS total, total >= v.target AS met,
{_TIER.format(n=len(thresholds), i='v.rung')} AS tier FROM ({cells}), (VALUES {values}) v(rung, target)"""


_BANDS = "(VALUES ('late', 0, 6), ('morning', 6, 12), ('afternoon', 12, 18), ('evening', 18, 24)) b(band, lo, hi)"
_MATRICES = " UNION ALL ".join([
    _matrix("weekday_hour", "SELECT w.i || '/' || h.i AS cell, coalesce((SELECT sum(total) FROM lnf WHERE isodow(day) - 1 = w.i AND hour = h.i), 0) AS total FROM range(7) w(i), range(24) h(i)", ms.WEEKDAY_HOUR),
    _matrix("month_band", f"SELECT m.i || '/' || band AS cell, coalesce((SELECT sum(total) FROM lnf WHERE month(day) = m.i AND hour >= lo AND hour < hi), 0) AS total FROM range(1, 13) m(i), {_BANDS}", ms.MONTH_BAND),
    _matrix("model_band", f"SELECT m.cm || '/' || band AS cell, coalesce((SELECT sum(total) FROM lnf x WHERE x.cm = m.cm AND hour >= lo AND hour < hi), 0) AS total FROM (SELECT DISTINCT cm FROM lnf) m, {_BANDS}", ms.MODEL_BAND),
    _matrix("hour", "SELECT CAST(h.i AS VARCHAR) AS cell, coalesce((SELECT sum(total) FROM lnf WHERE hour = h.i), 0) AS total FROM range(24) h(i)", ms.HOUR),
    _matrix("weekday", "SELECT CAST(w.i AS VARCHAR) AS cell, coalesce((SELECT sum(total) FROM lnf WHERE isodow(day) - 1 = w.i), 0) AS total FROM range(7) w(i)", ms.WEEKDAY),
    _matrix("month", "SELECT CAST(m.i AS VARCHAR) AS cell, coalesce((SELECT sum(total) FROM lnf WHERE month(day) = m.i), 0) AS total FROM range(1, 13) m(i)", ms.MONTH),
])


@query("C6 A17", f"WITH {folded('ln')} {_MATRICES}")
def matrix_milestones(t):
    return ms.matrix_milestones(t.kept("ln", "day hour model", *_DAY_SUMS))


_PAIRS = " UNION ALL ".join(
    f"""SELECT '{a}+{b}' AS pair, CAST(x.v AS DOUBLE) AS first_target, CAST(y.v AS DOUBLE) AS second_target, {_TIER.format(n=span, i='(x.i + y.i)')} AS tier,
(SELECT value FROM mv WHERE metric = '{a}') >= x.v AND (SELECT value FROM mv WHERE metric = '{b}') >= y.v AS met
FROM (VALUES {', '.join(f'({i}, {float(v)!r})' for i, v in enumerate(xs))}) x(i, v), (VALUES {', '.join(f'({i}, {float(v)!r})' for i, v in enumerate(ys))}) y(i, v)"""
    for a, xs, b, ys, span in ms.COMPOUND)


@query("C7", f"WITH {folded('ev')}, {_values('evf', '2024-01-30')} {_PAIRS}")
def compound_milestones(t):
    return ms.compound_milestones(ms.metric_values(t.kept("ev", "day hour source model", *_DAY_SUMS), *_entities(t, "ev"), "2024-01-31"))
