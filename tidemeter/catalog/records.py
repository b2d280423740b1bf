"""Seasons, records, history, work modes and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemeter.catalog.registry import query
from tidemeter.catalog.sql import EV, GP, folded
from tidemeter.functions import calendar as cal
from tidemeter.operators import modes as md
from tidemeter.operators import quality as ql
from tidemeter.operators import seasons as ss
from tidemeter.operators import turns as tn
from tidemeter.operators.cube import additive, in_range
from tidemeter.operators.snapshot import snapshot_id
from tidemeter.schema import COUNTERS

_DAY_SUMS = ("total", "calls", "input", "output", "cache_read", "cache_write")

_SEASON = """
d AS (SELECT day, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls, CAST(sum(coalesce(cache_read,0)) AS BIGINT) AS cache_read FROM {b} GROUP BY 1 HAVING sum(total) > 0),
e AS (SELECT *, lag(day) OVER (ORDER BY day) AS p FROM d),
f AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR month(p) <> month(day) OR year(p) <> year(day) OR day - p >= 8 THEN 1 ELSE 0 END) OVER (ORDER BY day) AS BIGINT) AS season FROM e),
sm AS (SELECT season, cm, CAST(sum(b.total) AS BIGINT) AS v FROM {b} b JOIN f USING (day) GROUP BY 1, 2),
sd AS (SELECT season, cm, v, row_number() OVER (PARTITION BY season ORDER BY v DESC, cm) AS rn FROM sm WHERE v > 0),
si AS (SELECT season, day - CAST(row_number() OVER (PARTITION BY season ORDER BY day) AS INTEGER) AS isl FROM f),
sl AS (SELECT season, max(n) AS longest_streak FROM (SELECT season, isl, count(*) AS n FROM si GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT season, min(day) AS s, max(day) AS e, CAST(sum(total) AS BIGINT) AS total, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(cache_read) AS BIGINT) AS cache_read,
count(*) AS active_days, max(total) AS peak_total, stddev_pop(total) / avg(total) AS cv FROM f GROUP BY 1),
h AS (SELECT g.*, sd.cm AS lead, sd.v AS lv, lag(sd.cm) OVER (ORDER BY g.season) AS pl, sl.longest_streak,
(SELECT day FROM f WHERE f.season = g.season ORDER BY f.total DESC, day LIMIT 1) AS pd FROM g LEFT JOIN sd ON g.season = sd.season AND rn = 1 JOIN sl ON sl.season = g.season),
sea AS (SELECT season, strftime(s, '%Y-%m-%d') AS start, strftime(e, '%Y-%m-%d') AS "end", total, calls, cache_read, active_days, date_diff('day', s, e) + 1 AS span_days,
lead AS dominant_model, round(lv / total, 6) AS dominant_share, strftime(pd, '%Y-%m-%d') AS peak_day, peak_total, longest_streak,
s = DATE '{since}' AS truncated_start, e = DATE '{until}' AS truncated_end,
CASE WHEN active_days < 5 THEN 'incipient' WHEN pl <> lead THEN 'migration' WHEN cv >= 1.15 THEN 'surge' WHEN cv <= 0.28 THEN 'steady' ELSE 'echo' END AS character FROM h)"""


def _season_frame(cube, since, until):
    rows = ss.seasons(cube, since, until)
    for c in ("start", "end", "peak_day"):
        rows = rows.withColumn(c, cal.iso(F.col(c)))
    return rows


@query("W21 W22", f"WITH {folded('gp')}, {_SEASON.format(b='gpf', since='2024-01-01', until='2024-03-05')} SELECT * FROM sea")
def seasons_with_gaps(t):
    return _season_frame(t.kept("gp", "day model", "total", "calls", "cache_read"), "2024-01-01", "2024-03-05")


@query("W21 W22", f"WITH {folded('ln')}, {_SEASON.format(b='lnf', since='1995-01-02', until='2001-11-04')} SELECT * FROM sea")
def seasons_by_month(t):
    return _season_frame(t.kept("ln", "day model", "total", "calls", "cache_read"), "1995-01-02", "2001-11-04")


_REC = """
{p}d AS (SELECT day, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls, sum(coalesce(input,0)) AS inp, sum(coalesce(output,0)) AS outp,
sum(coalesce(cache_read,0)) AS cr, sum(coalesce(cache_write,0)) AS cw FROM {b} GROUP BY 1),
{p}h AS (SELECT day, max(v) AS ph FROM (SELECT day, hour, sum(total) AS v FROM {b} WHERE hour IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
{p}m AS (SELECT day, count(*) AS mc FROM (SELECT day, cm, sum(total) AS v FROM {b} GROUP BY 1, 2) WHERE v > 0 GROUP BY 1),
{p}t0 AS (SELECT day, max(c) AS c FROM (SELECT day, sum(n) OVER (PARTITION BY session ORDER BY day) AS c FROM
  (SELECT session, day, count(*) AS n FROM {b} WHERE session <> '' GROUP BY 1, 2)) GROUP BY 1),
{p}t AS (SELECT d.day, max(c) OVER (ORDER BY d.day) AS mt FROM {p}d d LEFT JOIN {p}t0 USING (day)),
{p}x AS (SELECT d.*, ph, mc, mt FROM {p}d d LEFT JOIN {p}h USING (day) LEFT JOIN {p}m USING (day) LEFT JOIN {p}t USING (day)),
{p}l AS (SELECT day, 'peak-day-token' AS id, CAST(total AS DOUBLE) AS value FROM {p}x UNION ALL SELECT day, 'peak-day-calls', calls FROM {p}x
UNION ALL SELECT day, 'peak-hour-token', ph FROM {p}x UNION ALL SELECT day, 'peak-day-cache', cr FROM {p}x
UNION ALL SELECT day, 'peak-cache-ratio', cr / total FROM {p}x WHERE total >= 1000 UNION ALL SELECT day, 'peak-day-input', inp FROM {p}x
UNION ALL SELECT day, 'peak-day-output', outp FROM {p}x UNION ALL SELECT day, 'peak-day-cache-write', cw FROM {p}x
UNION ALL SELECT day, 'max-session-turns', mt FROM {p}x UNION ALL SELECT day, 'peak-model-diversity', mc FROM {p}x),
{p}r AS (SELECT id, value, day, row_number() OVER (PARTITION BY id ORDER BY value DESC, day) AS rn FROM {p}l WHERE value > 0),
{p}i AS (SELECT max(day) AS e, count(*) AS n FROM (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INTEGER) AS isl FROM {p}d WHERE total > 0) GROUP BY isl),
{p}rec AS (SELECT id, round(value, 6) AS value, strftime(day, '%Y-%m-%d') AS achieved FROM {p}r WHERE rn = 1
UNION ALL (SELECT 'longest-active-streak', CAST(n AS DOUBLE), strftime(e, '%Y-%m-%d') FROM {p}i ORDER BY n DESC, e LIMIT 1))"""


def _records(cube, sessions):
    rows = ss.record_days(cube, tn.running_max_turns(cube, sessions))
    return ss.personal_records(rows).withColumn("achieved", cal.iso(F.col("achieved")))


@query("W23", f"WITH {folded('gp')}, {_REC.format(p='cur_', b='gpf')} SELECT * FROM cur_rec")
def personal_records(t):
    return _records(t.kept("gp", "day hour model", *_DAY_SUMS), t.entities("gp", "session", "day entity"))


@query("W24 J6", f"""
WITH {folded('gp')}, old AS (SELECT * FROM gpf WHERE day <= DATE '2024-02-15'),
{_REC.format(p='cur_', b='gpf')}, {_REC.format(p='old_', b='old')}
SELECT a.id, a.value, a.achieved, o.value AS prior_value,
CASE WHEN o.value IS NULL THEN 'baseline' WHEN a.value > o.value THEN 'broken' WHEN a.value = o.value AND a.achieved <> o.achieved THEN 'tied'
WHEN a.value = o.value THEN 'standing' ELSE 'historic' END AS status, round(a.value - o.value, 6) AS delta FROM cur_rec a LEFT JOIN old_rec o USING (id)""")
def records_against_history(t):
    cube = t.kept("gp", "day hour model", *_DAY_SUMS)
    sessions = t.kept_entities("gp", "session")
    old = _records(in_range(cube, None, "2024-02-15"), in_range(sessions, None, "2024-02-15"))
    history = old.withColumn("generated", F.lit("2024-02-15"))
    return ss.against_history(_records(cube, sessions), history)


_SNAP = """
s0 AS (SELECT source || '/' || coalesce(model, 'unknown') AS scope, strftime(day, '%Y-%m-%d') AS generated, CAST(sum(total) AS BIGINT) AS volume FROM ev GROUP BY 1, 2),
s1 AS (SELECT scope, scope || '@' || generated AS id, generated, volume FROM s0)"""


@query("W25", f"""
WITH {EV}, {_SNAP}, k AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY generated DESC, id DESC) AS n FROM s1),
kk AS (SELECT * FROM k WHERE n <= 24), u AS (SELECT scope FROM kk GROUP BY 1 ORDER BY max(generated) DESC, scope LIMIT 8)
SELECT scope, id, generated, volume FROM kk WHERE scope IN (FROM u)""")
def history_upkeep(t):
    rows = additive(t.cube("ev", "day source model"), ["source", "model", "day"], ["total"]).select(
        F.concat_ws("/", "source", "model").alias("scope"), cal.iso(F.col("day")).alias("generated"),
        F.col("total").alias("volume"))
    rows = rows.select("scope", F.concat_ws("@", "scope", "generated").alias("id"), "generated", "volume")
    stale = rows.withColumn("volume", F.col("volume") - 1)
    fresh = rows.where("generated >= '2024-01-20'")
    earlier = rows.where("generated < '2024-01-20'").unionByName(stale.where("generated >= '2024-01-20'"))
    return ss.upsert_history(earlier, fresh)


@query("W26", f"""
WITH {folded('gp')}, dm AS (SELECT source AS scope, day, cm, CAST(sum(total) AS BIGINT) AS v FROM gpf GROUP BY 1, 2, 3),
s AS (SELECT scope, strftime(day, '%Y-%m-%d') AS generated, CAST(sum(v) AS BIGINT) AS volume,
  arg_max(cm, v) AS ld, strftime(day, '%Y-%m') AS sid FROM dm GROUP BY scope, day),
l AS (SELECT DISTINCT ON (scope, day) scope, strftime(day, '%Y-%m-%d') AS generated, cm AS ld FROM dm WHERE v > 0 ORDER BY scope, day, v DESC, cm),
z AS (SELECT s.scope, s.generated, volume, l.ld, sid FROM s LEFT JOIN l USING (scope, generated)),
y AS (SELECT *, lag(generated) OVER w AS pg, lag(volume) OVER w AS pt, lag(ld) OVER w AS pl, lag(sid) OVER w AS ps FROM z WINDOW w AS (PARTITION BY scope ORDER BY generated))
SELECT scope, generated, pg AS previous_generated, volume, volume - pt AS delta, round((volume - pt) / nullif(pt, 0), 6) AS ratio,
coalesce(pl <> ld, false) AS model_changed, CASE WHEN ps IS NULL THEN 'baseline' WHEN ps = sid THEN 'continued' ELSE 'new' END AS season_state,
CAST(coalesce(volume > pt, false) AS BIGINT) AS records_broken FROM y""")
def snapshot_story(t):
    from pyspark.sql import Window as W

    from tidemeter.operators.periods import dominant

    per = additive(t.folded("gp", "day source model"), ["source", "day", "model"], ["total"])
    lead = dominant(["source", "day"], per).select("source", "day", F.col("model").alias("dominant_model"))
    rows = additive(per, ["source", "day"], ["total"]).join(lead, ["source", "day"], "left").select(
        F.col("source").alias("scope"), cal.iso(F.col("day")).alias("generated"), F.col("total").alias("volume"),
        "dominant_model", F.date_format("day", "yyyy-MM").alias("season_id"))
    up = F.col("volume") > F.lag("volume").over(W.partitionBy("scope").orderBy("generated"))
    return ss.story_facts(rows.withColumn("records_broken", F.coalesce(up, F.lit(False)).cast("bigint")))


_MODES = """
d AS (SELECT day, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls, sum(coalesce(cache_read,0)) AS cr FROM {b} GROUP BY 1),
m AS (SELECT day, count(*) AS models FROM (SELECT day, cm, sum(total) AS v FROM {b} GROUP BY 1, 2) WHERE v <> 0 GROUP BY 1),
p AS (SELECT day, count(*) AS projects FROM (SELECT day, project, sum(total) AS v FROM {b} WHERE project <> '' GROUP BY 1, 2) WHERE v > 0 GROUP BY 1),
h AS (SELECT day, hour, sum(total) AS v FROM {b} WHERE hour IS NOT NULL GROUP BY 1, 2),
ah AS (SELECT day, count(*) FILTER (v > 0) AS active_hours FROM h GROUP BY 1),
q AS (SELECT day, max(w) AS four FROM (SELECT h.day, s.i, sum(v) AS w FROM h, range(24) s(i) WHERE (h.hour - s.i + 24) % 24 < 4 GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT d.day, total, calls, CASE WHEN total = 0 THEN 0 ELSE cr / total END AS cache_ratio, coalesce(models, 0) AS models, coalesce(projects, 0) AS projects,
coalesce(active_hours, 0) AS active_hours, coalesce(four / nullif(total, 0), 0) AS four_hour_share,
coalesce(median(total) FILTER (total >= 1000) OVER (), 0) AS med
FROM d LEFT JOIN m USING (day) LEFT JOIN p USING (day) LEFT JOIN ah USING (day) LEFT JOIN q USING (day)),
md AS (SELECT *, CASE WHEN total < 1000 THEN 'insufficient' WHEN cache_ratio >= 0.35 THEN 'cache' WHEN models >= 3 OR projects >= 4 THEN 'explore'
WHEN active_hours BETWEEN 1 AND 6 AND four_hour_share >= 0.72 THEN 'deep' WHEN med > 0 AND total >= med * 1.8 THEN 'sprint' ELSE 'cruise' END AS mode FROM x)"""


def _modes(t, name):
    return md.classify(md.daily_features(t.kept(name, "day hour model", "total", "calls", "cache_read"), t.entities(name, "project", "day entity")))


@query("C1 C2", f"""
WITH {folded('ln')}, {_MODES.format(b='lnf')}
SELECT strftime(day, '%Y-%m-%d') AS day, total, calls, round(cache_ratio, 6) AS cache_ratio, models, projects, active_hours,
round(four_hour_share, 6) AS four_hour_share, round(med, 4) AS median, mode FROM md""")
def work_modes(t):
    rows = _modes(t, "ln")
    return rows.select(
        cal.iso(F.col("day")).alias("day"), "total", "calls", F.round("cache_ratio", 6).alias("cache_ratio"),
        "models", "projects", "active_hours", F.round("four_hour_share", 6).alias("four_hour_share"),
        F.round("median", 4).alias("median"), "mode")


@query("C3", f"""
WITH {folded('ev')}, {_MODES.format(b='evf')}, c AS (SELECT mode, count(*) AS days FROM md WHERE mode <> 'insufficient' GROUP BY 1)
SELECT *, round(days / sum(days) OVER (), 6) AS share FROM c""")
def work_mode_counts(t):
    return md.mode_counts(_modes(t, "ev"))


_COV = """count(*) AS records, CAST(sum(total) AS BIGINT) AS total, count(ts) AS valid_ts, count(*) FILTER (project <> '') AS with_project,
count(*) FILTER (session <> '') AS with_session, count(input) AS with_input, count(output) AS with_output, count(cache_read) AS with_cache_read,
count(cache_write) AS with_cache_write, count(input + output + cache_read + cache_write) AS with_components,
strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day"""


@query("P1 A12", f"WITH {EV} SELECT 'all' AS source, {_COV} FROM ev UNION ALL SELECT source, {_COV} FROM ev GROUP BY 1")
def field_coverage(t):
    return ql.provenance(t.cube("ev", "day source"))


@query("P2", f"""
WITH {EV} SELECT strftime(max(day), '%Y-%m-%d') AS last_day, date_diff('day', max(day), DATE '2024-02-01') AS age_days,
CASE WHEN max(day) = DATE '2024-02-01' THEN 'fresh' WHEN date_diff('day', max(day), DATE '2024-02-01') <= 3 THEN 'recent' ELSE 'stale' END AS freshness FROM ev""")
def freshness(t):
    return ql.freshness(ql.provenance(t.cube("ev", "day source")), "2024-02-01")


@query("P3", f"""
WITH {EV}, c AS (SELECT {_COV} FROM ev), r AS (SELECT round(valid_ts / records, 6) AS valid_ts_ratio, round(with_project / records, 6) AS with_project_ratio,
round(with_session / records, 6) AS with_session_ratio, round(with_components / records, 6) AS with_components_ratio FROM c)
SELECT *, CASE WHEN valid_ts_ratio >= 0.95 AND with_project_ratio >= 0.7 AND with_session_ratio >= 0.7 AND with_components_ratio >= 0.9 THEN 'full'
WHEN valid_ts_ratio >= 0.9 AND (with_project_ratio >= 0.25 OR with_session_ratio >= 0.25) THEN 'trend' ELSE 'base' END AS grade FROM r""")
def health_grade(t):
    return ql.health(ql.provenance(t.cube("ev", "day source")))


@query("P4", f"""
WITH {EV}, c AS (SELECT {_COV} FROM ev), k AS (SELECT sum(least(n, 200)) AS kept FROM (SELECT count(*) AS n FROM ev WHERE session <> '' GROUP BY session)),
l AS (SELECT 'project' AS capability, with_project / records AS r FROM c UNION ALL SELECT 'session', kept / records FROM c, k
UNION ALL SELECT 'rhythm', valid_ts / records FROM c UNION ALL SELECT 'reuse', with_components / records FROM c
UNION ALL SELECT 'flow', greatest(with_project, with_session) / records FROM c)
SELECT capability, round(r, 6) AS ratio, CASE WHEN round(r, 6) >= 0.85 THEN 'ok' WHEN r > 0 THEN 'partial' ELSE 'off' END AS status FROM l""")
def capabilities(t):
    return ql.capabilities(ql.provenance(t.cube("ev", "day source")), tn.replay_counts(t.entities("ev", "session", "entity")))


_FIELDS = ", ".join(f"CAST(sum(coalesce({c},0)) AS BIGINT)" for c in COUNTERS)


@query("A13", f"""
WITH {EV}, r AS (SELECT day, sha256(concat_ws('|', coalesce(model, 'unknown'), source, count(*), {_FIELDS})) AS h FROM ev GROUP BY day, model, source),
d AS (SELECT day, sha256(string_agg(h, '' ORDER BY h)) AS g FROM r GROUP BY 1),
e AS (SELECT day, strftime(day, '%Y-%m-%d') || '=' || g AS l FROM d)
SELECT left(sha256(string_agg(l, ';' ORDER BY l)), 24) AS snapshot_id, strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day FROM e""")
def snapshot_identity(t):
    return snapshot_id(t.cube("ev", "day source model"))

