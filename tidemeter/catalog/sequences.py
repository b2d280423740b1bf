"""Running values, streaks, trends and moments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemeter.catalog.registry import query
from tidemeter.catalog.sql import EV, GP, LN, folded
from tidemeter.functions import calendar as cal
from tidemeter.operators import sequence as sq
from tidemeter.operators.cube import usage_cube

_DAY_SUMS = ("total", "calls", "input", "output", "cache_read", "cache_write")
_DAYS = """d AS (SELECT day, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls, CAST(sum(coalesce(cache_read,0)) AS BIGINT) AS cache_read,
CAST(sum(coalesce(input,0)) AS BIGINT) AS input, CAST(sum(coalesce(output,0)) AS BIGINT) AS output, CAST(sum(coalesce(cache_write,0)) AS BIGINT) AS cache_write,
CAST(coalesce(sum(total) FILTER (source='claude'),0) AS BIGINT) AS source_claude, CAST(coalesce(sum(total) FILTER (source='gemini'),0) AS BIGINT) AS source_gemini,
CAST(coalesce(sum(total) FILTER (source='codex'),0) AS BIGINT) AS source_codex,
CAST(coalesce(sum(total) FILTER (source IS NULL OR source NOT IN ('claude', 'gemini', 'codex')),0) AS BIGINT) AS source_other FROM {base} GROUP BY 1)"""
_ISLANDS = """i0 AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS isl FROM d WHERE total > 0),
i1 AS (SELECT min(day) AS s, max(day) AS e, count(*) AS n FROM i0 GROUP BY isl)"""
_RUN = ("total", "calls", "cache_read", "input", "output", "cache_write", "source_claude", "source_gemini", "source_codex", "source_other")


@query("W2", f"""
WITH {GP}, {_DAYS.format(base='gp')}, i AS (SELECT *, CASE WHEN total > 0 THEN day - CAST(sum(CAST(total > 0 AS INTEGER)) OVER (ORDER BY day) AS INTEGER) END AS isl FROM d),
j AS (SELECT *, CASE WHEN total > 0 THEN row_number() OVER (PARTITION BY isl ORDER BY day) END AS len FROM i)
SELECT strftime(day, '%Y-%m-%d') AS day, {', '.join(f'CAST(sum({c}) OVER w AS BIGINT) AS {c}' for c in _RUN)},
greatest(max(total) OVER w, 0) AS max_day, CAST(sum(CAST(total > 0 AS INTEGER)) OVER w AS BIGINT) AS active_days,
coalesce(max(len) OVER w, 0) AS longest_streak FROM j WINDOW w AS (ORDER BY day)""")
def running_totals(t):
    return sq.running_totals(t.cube("gp", "day source")).withColumn("day", cal.iso(F.col("day")))


@query("W2 A8", f"""
WITH {EV}, s AS (SELECT day, CASE WHEN seq % 7 = 0 THEN 'own-tool' WHEN seq % 11 = 0 THEN 'unknown' ELSE source END AS source, total FROM ev),
d AS (SELECT day, source, CAST(sum(total) AS BIGINT) AS total FROM s GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, source, total, CAST(sum(total) OVER (PARTITION BY source ORDER BY day) AS BIGINT) AS running FROM d""")
def source_running_totals(t):
    """With a source of one's own and records that name none."""
    source = F.when(F.col("seq") % 7 == 0, "own-tool").when(F.col("seq") % 11 != 0, F.col("source"))
    cube = usage_cube(t.rec("ev").withColumn("source", source), ["day", "source"])
    return sq.source_running_totals(cube).withColumn("day", cal.iso(F.col("day")))


@query("W3", f"""
WITH {folded('ln')}, days AS (SELECT DISTINCT day FROM lnf),
f AS (SELECT 'hours' AS kind, min(day) AS day FROM lnf WHERE total <> 0 GROUP BY hour
UNION ALL SELECT 'models', min(day) FROM lnf WHERE total <> 0 GROUP BY cm
UNION ALL SELECT 'projects', min(day) FROM lnf GROUP BY project
UNION ALL SELECT 'sessions', min(day) FROM lnf GROUP BY session),
x AS (SELECT days.day, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ('hours', 'models', 'projects', 'sessions'))}
FROM days LEFT JOIN f ON days.day = f.day GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, {', '.join(f'CAST(sum({k}) OVER (ORDER BY day) AS BIGINT) AS {k}' for k in ('hours', 'models', 'projects', 'sessions'))} FROM x""")
def running_distinct(t):
    cube = t.kept("ln", "day hour model", *_DAY_SUMS)
    rows = sq.running_distinct(sq.day_totals(cube), sq.first_seen(cube, t.entities("ln", "project", "day entity"), t.entities("ln", "session", "day entity")))
    return rows.withColumn("day", cal.iso(F.col("day")))


@query("W13", f"""
WITH {GP}, {_DAYS.format(base='gp')}, {_ISLANDS}
SELECT coalesce(max(n) FILTER (e = DATE '2024-03-05'), 0) AS current, max(n) AS longest,
strftime((SELECT e FROM i1 ORDER BY n DESC, e LIMIT 1), '%Y-%m-%d') AS longest_end FROM i1""")
def activity_streaks(t):
    rows = sq.streaks(sq.day_totals(t.cube("gp", "day")), "2024-03-05")
    return rows.withColumn("longest_end", cal.iso(F.col("longest_end")))


@query("W14", f"""
WITH {GP} SELECT CASE WHEN max(day) >= DATE '2024-03-20' THEN 'active' ELSE 'quiet' END AS state,
greatest(date_diff('day', max(day), DATE '2024-03-20'), 0) AS quiet_days FROM gp WHERE total > 0""")
def quiet_tail(t):
    return sq.quiet_tail(sq.day_totals(t.cube("gp", "day")), "2024-03-20")


_TREND = """b AS (SELECT min(day) AS a FROM {base} WHERE day <= DATE '{last}'),
s AS (SELECT CAST(unnest(generate_series(a, DATE '{last}', INTERVAL 1 DAY)) AS DATE) AS day FROM b),
v AS (SELECT s.day, coalesce((SELECT sum(total) FROM {base} x WHERE x.day = s.day), 0) AS total FROM s),
w AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS back, coalesce(sign(total - lag(total) OVER (ORDER BY day)), 0) AS step FROM v),
g AS (SELECT count(*) AS n, avg(total) FILTER (back <= 7) AS a7, avg(total) FILTER (back <= 30) AS a30, avg(total) FILTER (back BETWEEN 8 AND 14) AS p7,
min(back) FILTER (step <> 1) - 1 AS gs, min(back) FILTER (step <> -1) - 1 AS ds FROM w)
SELECT n AS complete_days, round(a7, 4) AS avg7, round(a30, 4) AS avg30,
round(CASE WHEN n >= 14 AND p7 > 0 THEN a7 / p7 - 1 ELSE 0 END, 6) AS momentum, gs AS growth_streak, ds AS decline_streak FROM g"""


@query("W15 J5", f"WITH {EV}, {_TREND.format(base='ev', last='2024-01-29')}")
def trend_dense(t):
    return sq.trend(sq.day_totals(t.cube("ev", "day")), "2024-01-30")


@query("W15 J5", f"WITH {GP}, {_TREND.format(base='gp', last='2024-02-25')}")
def trend_with_gaps(t):
    return sq.trend(sq.day_totals(t.cube("gp", "day")), "2024-04-01", until="2024-02-25")


@query("J5", f"""
WITH {GP}, s AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM gp), DATE '2024-03-10', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT strftime(s.day, '%Y-%m-%d') AS day, CAST(coalesce(sum(total), 0) AS BIGINT) AS total FROM s LEFT JOIN gp ON s.day = gp.day GROUP BY 1""")
def dense_calendar(t):
    return sq.dense(sq.day_totals(t.cube("gp", "day")), None, "2024-03-10").withColumn("day", cal.iso(F.col("day")))


_CROSS = """r AS (SELECT day, CAST(sum(total) OVER (ORDER BY day) AS BIGINT) AS reached, total FROM d),
m AS (SELECT CAST(pow(10, n) AS BIGINT) AS milestone FROM range(3, 13) t(n)),
x AS (SELECT day, reached, milestone FROM r JOIN m ON milestone > reached - total AND milestone <= reached)"""


@query("W17", f"""
WITH {LN}, {_DAYS.format(base='ln')}, {_CROSS} SELECT strftime(day, '%Y-%m-%d') AS day, reached, milestone FROM x""")
def milestone_crossings(t):
    return sq.milestone_crossings(sq.day_totals(t.cube("ln", "day"))).withColumn("day", cal.iso(F.col("day")))


_LEAD = """lm AS (SELECT day, cm, CAST(sum(total) AS BIGINT) AS v FROM {base} GROUP BY 1, 2),
mx AS (SELECT day, max(v) AS mv FROM lm GROUP BY 1),
ld AS (SELECT mx.day, CASE WHEN mv > 0 AND count(*) = 1 THEN any_value(cm) END AS leader FROM mx JOIN lm ON lm.day = mx.day AND lm.v = mx.mv GROUP BY mx.day, mv),
rl AS (SELECT a.day, b.leader AS from_model, a.leader AS to_model FROM ld a JOIN ld b ON b.day = a.day - 1 WHERE a.leader <> b.leader)"""


@query("W18", f"""
WITH {folded('ln')}, {_LEAD.format(base='lnf')} SELECT strftime(day, '%Y-%m-%d') AS day, from_model, to_model FROM rl""")
def leader_relays(t):
    return sq.relays(sq.daily_leader(t.folded("ln", "day model"))).withColumn("day", cal.iso(F.col("day")))


@query("W19", f"""
WITH {GP} SELECT project AS entity, strftime(min(day), '%Y-%m-%d') AS day FROM gp WHERE total > 0 AND project <> '' GROUP BY 1""")
def first_observed_projects(t):
    return sq.first_observed(t.entities("gp", "project", "entity")).withColumn("day", cal.iso(F.col("day")))


@query("W19", f"""
WITH {GP} SELECT project AS entity, strftime(min(day), '%Y-%m-%d') AS day FROM gp WHERE total > 0 AND project <> '' GROUP BY 1
ORDER BY day DESC, entity LIMIT 1""")
def newest_project(t):
    firsts = sq.first_observed(t.entities("gp", "project", "entity"))
    return sq.newest_entity(firsts).withColumn("day", cal.iso(F.col("day")))


@query("W20", f"""
WITH {folded('gp')}, {_DAYS.format(base='gpf')}, {_CROSS}, {_LEAD.format(base='gpf')},
np AS (SELECT project, min(day) AS day FROM gpf WHERE project <> '' GROUP BY 1),
e AS ((SELECT 'milestone' AS kind, day, CAST(milestone AS VARCHAR) AS label FROM x ORDER BY day DESC, milestone DESC LIMIT 1)
UNION ALL (SELECT 'project', day, project FROM np ORDER BY day DESC, project LIMIT 1)
UNION ALL (SELECT 'relay', day, from_model || ' > ' || to_model FROM rl ORDER BY day DESC LIMIT 1))
SELECT strftime(date_trunc('month', day), '%Y-%m-%d') AS period, count(*) AS events, strftime(max(day), '%Y-%m-%d') AS day,
string_agg(kind || '=' || label, '; ' ORDER BY day, kind, label) AS label FROM e GROUP BY 1""")
def moment_events(t):
    rows = sq.moments(t.kept("gp", "day model", *_DAY_SUMS), t.entities("gp", "project", "entity"), "month")
    return rows.withColumn("period", cal.iso(F.col("period"))).withColumn("day", cal.iso(F.col("day")))
