"""Project, session and relation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemeter.catalog.registry import query
from tidemeter.catalog.sql import EV, LN, folded
from tidemeter.functions import calendar as cal
from tidemeter.functions import labels
from tidemeter.operators import entities as en
from tidemeter.operators import turns as tn


@query("A3", f"""
WITH {LN} SELECT project AS member, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1 ORDER BY total DESC, member LIMIT 8""")
def top_projects(t):
    return en.top_by(t.rec("ln"), "project")


@query("A3", f"""
WITH {LN} SELECT session AS member, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1 ORDER BY total DESC, member LIMIT 8""")
def top_sessions(t):
    return en.top_by(t.rec("ln"), "session")


@query("A9", f"""
WITH {folded('ln')} SELECT project AS entity, cm AS model, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls
FROM lnf GROUP BY 1, 2""")
def project_model_totals(t):
    return en.entity_model(t.entities("ln", "project"))


@query("A9 A21", f"""
WITH {LN}, p AS (SELECT project, count(*) AS n, sum(total) AS v FROM ln GROUP BY 1), s AS (SELECT session, count(*) AS n, sum(total) AS v FROM ln GROUP BY 1)
SELECT 'project' AS kind, count(*) AS entities, max(n) AS max_turns, CAST(max(v) AS BIGINT) AS max_total FROM p
UNION ALL SELECT 'session', count(*), max(n), CAST(max(v) AS BIGINT) FROM s""")
def entity_counts(t):
    return en.entity_counts(t.rec("ln"))


@query("A10", f"""
WITH {folded('ev')} SELECT 'project_model' AS relation, project AS entity, cm AS model, CAST(sum(total) AS BIGINT) AS total
FROM evf WHERE project <> '' GROUP BY 2, 3
UNION ALL SELECT 'model_session', session, cm, CAST(sum(total) AS BIGINT) FROM evf WHERE session <> '' GROUP BY 2, 3""")
def relation_edges(t):
    left = en.edges(t.entities("ev", "project")).withColumn("relation", F.lit("project_model"))
    right = en.edges(t.entities("ev", "session")).withColumn("relation", F.lit("model_session"))
    return left.unionByName(right)


@query("A11", f"""
WITH {EV} SELECT session AS entity, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls FROM ev WHERE session <> '' GROUP BY 1""")
def session_totals(t):
    return en.entity_totals(t.entities("ev", "session", "entity"))


_TOPS = """
x AS (SELECT {kind} AS entity, cm AS model, CAST(sum(total) AS BIGINT) AS total FROM {base} WHERE {kind} <> '' {extra} GROUP BY 1, 2),
tops AS (SELECT entity, CAST(sum(total) AS BIGINT) AS total FROM x GROUP BY 1 HAVING sum(total) > 0 ORDER BY total DESC, entity LIMIT 6)
SELECT t.entity, t.total, row_number() OVER (ORDER BY t.total DESC, t.entity) AS rank,
(SELECT model FROM x WHERE x.entity = t.entity ORDER BY x.total DESC, model LIMIT 1) AS dominant_model,
(SELECT max(x.total) FROM x WHERE x.entity = t.entity) AS dominant_total,
(SELECT string_agg(model || ':' || x.total, ',' ORDER BY x.total DESC, model) FROM x WHERE x.entity = t.entity) AS composition
FROM tops t"""


@query("T4", f"WITH {folded('ln')}, {_TOPS.format(kind='project', base='lnf', extra='')}")
def top_projects_composed(t):
    return en.top_entities(t.entities("ln", "project"))


@query("T4 F3", "WITH " + folded("ev") + ", " + _TOPS.format(kind="session", base="evf", extra="AND cm IN ('click', 'view', 'error')"))
def top_sessions_of_models(t):
    return en.top_entities(t.entities("ev", "session"), ["click", "view", "error"])


@query("T4", f"""
WITH {LN}, x AS (SELECT day, project AS entity, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total DESC, entity) AS rank FROM x)
SELECT strftime(day, '%Y-%m-%d') AS day, entity, total, rank FROM y WHERE rank <= 6""")
def top_projects_by_day(t):
    rows = en.top_entities_by_day(t.entities("ln", "project", "day entity"))
    return rows.withColumn("day", cal.iso(F.col("day")))


@query("T5 X11", f"""
WITH {folded('ln')}, x AS (SELECT project AS entity, CAST(date_trunc('month', day) AS DATE) AS period,
  CAST(sum(total) AS BIGINT) AS total, min(day) FILTER (total > 0) AS fd FROM lnf GROUP BY 1, 2),
m AS (SELECT project AS entity, cm AS model, sum(total) AS total FROM lnf GROUP BY 1, 2),
f AS (SELECT entity, CAST(sum(total) AS BIGINT) AS total, count(*) AS active_periods, min(fd) AS fd,
  arg_max(period, total * 100000 - date_diff('day', DATE '1970-01-01', period)) AS pp, max(total) AS peak_total FROM x WHERE total > 0 GROUP BY 1)
SELECT f.entity, array_to_string(string_split(f.entity, '/')[-2:], '/') AS label, f.total,
round(f.total / (SELECT sum(total) FROM lnf), 6) AS share, active_periods, strftime(fd, '%Y-%m-%d') AS first_day,
strftime(pp, '%Y-%m-%d') AS peak_period, peak_total,
(SELECT model FROM m WHERE m.entity = f.entity AND m.total > 0 ORDER BY m.total DESC, model LIMIT 1) AS dominant_model FROM f""")
def project_catalogue(t):
    rows = en.catalogue(t.kept_entities("ln", "project", "period entity model", "month"), t.rec("ln").agg(F.sum("total")))
    return rows.withColumn("first_day", cal.iso(F.col("first_day"))).withColumn("peak_period", cal.iso(F.col("peak_period")))


@query("T5", f"""
WITH {folded('ln')} SELECT project AS entity, strftime(date_trunc('month', day), '%Y-%m-%d') AS period, cm AS model,
CAST(sum(total) AS BIGINT) AS total FROM lnf GROUP BY 1, 2, 3 HAVING sum(total) > 0""")
def project_series(t):
    return en.entity_series(t.entities("ln", "project", "period entity model", "month")).withColumn("period", cal.iso(F.col("period")))


@query("T6", f"""
WITH {folded('ev')},
pm AS (SELECT project AS entity, cm AS model, CAST(sum(total) AS BIGINT) AS total FROM evf WHERE project <> '' GROUP BY 1, 2),
ms AS (SELECT session AS entity, cm AS model, CAST(sum(total) AS BIGINT) AS total FROM evf WHERE session <> '' GROUP BY 1, 2),
per AS (SELECT model, sum(total) AS v FROM pm GROUP BY 1 UNION ALL SELECT model, sum(total) FROM ms GROUP BY 1),
tm AS (SELECT model FROM per GROUP BY 1 ORDER BY max(v) DESC, model LIMIT 7),
p AS (SELECT * FROM pm WHERE model IN (FROM tm) AND total > 0), s AS (SELECT * FROM ms WHERE model IN (FROM tm) AND total > 0),
tp AS (SELECT entity FROM p GROUP BY 1 ORDER BY sum(total) DESC, entity LIMIT 7),
ts AS (SELECT entity FROM s GROUP BY 1 ORDER BY sum(total) DESC, entity LIMIT 8)
SELECT 'project_model' AS relation, * FROM p WHERE entity IN (FROM tp)
UNION ALL SELECT 'model_session', * FROM s WHERE entity IN (FROM ts)""")
def flow_slice(t):
    return en.flow_slice(en.edges(t.kept_entities("ev", "project", "entity model")), en.edges(t.kept_entities("ev", "session", "entity model")))


@query("A18", f"""
WITH {LN}, d AS (SELECT day, CAST(sum(total) AS BIGINT) AS total, count(*) AS calls FROM ln GROUP BY 1),
s AS (SELECT session, sum(total) AS total FROM ln GROUP BY 1), p AS (SELECT project, sum(total) AS total FROM ln GROUP BY 1),
a AS (SELECT count(*) AS days, CAST(sum(total) AS BIGINT) AS total, CAST(sum(calls) AS BIGINT) AS calls, avg(total) AS m, stddev_pop(total) AS sd, max(total) AS day_max FROM d),
b AS (SELECT count(*) AS sessions, CAST(max(total) AS BIGINT) AS session_max, median(total) AS med FROM s),
c AS (SELECT count(*) AS projects, CAST(max(total) AS BIGINT) AS project_max FROM p)
SELECT days, total, calls, sessions, projects, round(m, 4) AS day_mean, day_max, round(sd / m, 6) AS day_cv,
round(total / sessions, 4) AS session_mean, round(med, 4) AS session_median, session_max,
round(total / projects, 4) AS project_mean, project_max, round(total / calls, 4) AS volume_per_call,
round(calls / days, 4) AS calls_per_day, round(sessions / days, 4) AS sessions_per_day FROM a, b, c""")
def distribution_statistics(t):
    return en.distribution(t.cube("ln", "day"), t.entities("ln", "project", "entity"), t.entities("ln", "session", "entity"))


@query("A19", f"""
WITH {folded('ev')}, x AS (SELECT cm, sum(total) AS v FROM evf GROUP BY 1), y AS (SELECT v / sum(v) OVER () AS p FROM x)
SELECT round(max(p), 6) AS top_share, round(sum(p * p), 6) AS herfindahl FROM y""")
def model_concentration(t):
    return en.concentration(t.folded("ev", "model"))


_REPLAY = """
r AS (SELECT session, total, row_number() OVER (PARTITION BY session ORDER BY ts_raw DESC, seq DESC, total DESC) AS back FROM {base} WHERE session <> ''),
k AS (SELECT session, total, row_number() OVER (PARTITION BY session ORDER BY back DESC) AS turn FROM r WHERE back <= {keep})
SELECT session, turn, CAST(total AS BIGINT) AS total,
CAST(sum(total) OVER (PARTITION BY session ORDER BY turn) AS BIGINT) AS running,
round(coalesce(sum(total) OVER (PARTITION BY session ORDER BY turn) / nullif(sum(total) OVER (PARTITION BY session), 0), 0), 6) AS running_share FROM k"""


@query("W5 W6", f"WITH {EV}, {_REPLAY.format(base='ev', keep=200)}")
def session_replay(t):
    return tn.replay(t.rec("ev"))


@query("W5", f"WITH {LN}, {_REPLAY.format(base='ln', keep=3)}")
def session_replay_last_three(t):
    return tn.replay(t.rec("ln"), keep=3)


@query("A21 P1", f"""
WITH {EV}, x AS (SELECT session, count(*) AS n FROM ev WHERE session <> '' GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS replay_eligible, CAST(sum(least(n, 200)) AS BIGINT) AS replay_retained, max(n) AS max_turns FROM x""")
def replay_counts(t):
    return tn.replay_counts(t.entities("ev", "session", "entity"))


@query("W4", f"""
WITH {EV}, x AS (SELECT session, day, count(*) AS n FROM ev WHERE session <> '' GROUP BY 1, 2),
y AS (SELECT day, sum(n) OVER (PARTITION BY session ORDER BY day) AS c FROM x), z AS (SELECT day, max(c) AS c FROM y GROUP BY 1)
SELECT strftime(d.day, '%Y-%m-%d') AS day, CAST(coalesce(max(c) OVER (ORDER BY d.day), 0) AS BIGINT) AS max_turns
FROM (SELECT DISTINCT day FROM ev) d LEFT JOIN z ON d.day = z.day""")
def running_max_turns(t):
    return tn.running_max_turns(t.cube("ev", "day"), t.entities("ev", "session", "day entity")).withColumn("day", cal.iso(F.col("day")))


@query("X11 X12", f"""
WITH {EV} SELECT DISTINCT 'project' AS kind, project AS member, array_to_string(string_split(project, '/')[-2:], '/') AS label FROM ev WHERE project <> ''
UNION SELECT DISTINCT 'session', session, left(session, 8) FROM ev WHERE session <> ''""")
def entity_labels(t):
    rec = t.rec("ev")
    p = rec.where("project <> ''").select(F.lit("project").alias("kind"), F.col("project").alias("member")).distinct()
    s = rec.where("session <> ''").select(F.lit("session").alias("kind"), F.col("session").alias("member")).distinct()
    return p.withColumn("label", labels.project_label(F.col("member"))).unionByName(
        s.withColumn("label", labels.session_label(F.col("member"))))
