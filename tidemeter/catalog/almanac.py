"""Snapshots stored, compared and exported."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemeter.catalog.records import _DAY_SUMS, _FIELDS, _REC, _SEASON
from tidemeter.catalog.registry import query
from tidemeter.catalog.sql import folded
from tidemeter.operators import almanac as al
from tidemeter.operators.cube import in_range
from tidemeter.plans.almanac import SnapshotStore
from tidemeter.session import shared_dir

UNTIL = "2024-02-15"
SCOPE = al.scope_key(["claude", "codex", "gemini"])


def _shots(t):
    """The report as it was on a day in between, and as it is at the end."""
    cube, sessions = t.kept("gp", "day hour source model", *_DAY_SUMS), t.kept_entities("gp", "session")
    early = al.summarise(in_range(cube, None, UNTIL), in_range(sessions, None, UNTIL), SCOPE, "2024-02-16", until=UNTIL)
    return early, al.summarise(cube, sessions, SCOPE, "2024-04-02")


def _stored(t):
    store = SnapshotStore(t.spark, shared_dir(t.spark, "almanac"))
    early, late = _shots(t)
    first = store.observe(early)
    second = store.observe(late)
    return store, first, second


def _id(b):
    return f"""(SELECT left(sha256(string_agg(l, ';' ORDER BY l)), 24) FROM (SELECT strftime(day, '%Y-%m-%d') || '=' || sha256(string_agg(h, '' ORDER BY h)) AS l FROM
(SELECT day, sha256(concat_ws('|', cm, source, count(*), {_FIELDS})) AS h FROM {b} GROUP BY day, cm, source) GROUP BY day))"""


def _lead(b):
    return f"(SELECT cm FROM (SELECT cm, sum(total) AS v FROM {b} GROUP BY 1) WHERE v > 0 ORDER BY v DESC, cm LIMIT 1)"


_OLD = f"{folded('gp')}, old AS (SELECT * FROM gpf WHERE day <= DATE '{UNTIL}')"
_TOTALS = """strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day,
CAST(sum(total) AS BIGINT) AS tokens, count(*) AS calls, CAST(sum(coalesce(cache_read,0)) AS BIGINT) AS cache, count(DISTINCT cm) AS models"""
_SEASONS = lambda b: _SEASON.format(b=b, since="1900-01-01", until="1900-01-01")


def _details(p, b):
    """Records with precision and detail as ``{p}det``."""
    return f"""{_REC.format(p=p, b=b)},
{p}det AS (SELECT id, value, achieved, CASE id WHEN 'max-session-turns' THEN 'range-day' WHEN 'longest-active-streak' THEN
  CASE WHEN (SELECT count(*) FROM {p}d WHERE strftime(day, '%Y-%m-%d') <= r.achieved) = value AND (SELECT arg_min(total, day) FROM {p}d) > 0 THEN 'range-boundary' ELSE 'exact-day' END
  ELSE 'exact-day' END AS precision,
CASE id WHEN 'longest-active-streak' THEN achieved WHEN 'peak-hour-token' THEN (SELECT lpad(CAST(arg_max(hour, v * 100 - hour) AS VARCHAR), 2, '0') || ':00' FROM
  (SELECT strftime(day, '%Y-%m-%d') AS dd, hour, sum(total) AS v FROM {b} WHERE hour IS NOT NULL GROUP BY 1, 2) WHERE dd = r.achieved) ELSE '' END AS detail FROM {p}rec r)"""


@query("W25 S11", f"""WITH {_OLD}, se AS (WITH {_SEASONS('gpf').lstrip()} SELECT count(*) AS n, arg_max(start || '..' || "end", start) AS l FROM sea),
so AS (WITH {_SEASONS('old').lstrip()} SELECT count(*) AS n, arg_max(start || '..' || "end", start) AS l FROM sea)
SELECT '{SCOPE}' AS scope, {_id('old')} AS id, '2024-02-16' AS generated, {_TOTALS}, (SELECT n FROM so) AS seasons, (SELECT l FROM so) AS latest FROM old
UNION ALL SELECT '{SCOPE}', {_id('gpf')}, '2024-04-02', {_TOTALS}, (SELECT n FROM se), (SELECT l FROM se) FROM gpf""")
def stored_snapshots(t):
    """Two snapshots of one report, the second observed twice: one row each."""
    store, _, _ = _stored(t)
    store.put(store.snapshots().where("generated = '2024-04-02'"))
    count = lambda c: F.size(c).cast("bigint").alias(c)
    return store.snapshots().select(
        "scope", "id", "generated", "first_day", "last_day", "tokens", "calls", "cache", count("models"), count("seasons"),
        F.element_at("seasons", -1)["id"].alias("latest"))


@query("W23 W24 J6", f"""WITH {_OLD}, {_details('cur_', 'gpf')}, {_details('old_', 'old')}
SELECT a.id, a.value, a.achieved, a.precision, a.detail, CASE a.id WHEN 'peak-cache-ratio' THEN 'percent' ELSE 'number' END AS format,
CASE WHEN o.value IS NULL THEN 'baseline' WHEN a.value > o.value THEN 'broken' WHEN a.value = o.value AND a.achieved <> o.achieved THEN 'tied'
WHEN a.value = o.value THEN 'standing' ELSE 'historic' END AS status, round(a.value - o.value, 6) AS delta,
o.value AS prior_value, o.achieved AS prior_achieved, o.precision AS prior_precision, o.detail AS prior_detail FROM cur_det a LEFT JOIN old_det o USING (id)""")
def stored_records(t):
    """Records of the second snapshot against the stored first one, with precision and detail of both."""
    _, _, (compared, _) = _stored(t)
    return compared.drop("scope", "snapshot")


@query("W26 W24", f"""WITH {_OLD}, {_REC.format(p='cur_', b='gpf')}, {_REC.format(p='old_', b='old')},
se AS (WITH {_SEASONS('gpf').lstrip()} SELECT start, start || '..' || "end" AS id FROM sea), so AS (WITH {_SEASONS('old').lstrip()} SELECT start, start || '..' || "end" AS id FROM sea),
b AS (SELECT id FROM cur_rec JOIN old_rec o USING (id) WHERE cur_rec.value > o.value), x AS (SELECT (SELECT CAST(sum(total) AS BIGINT) FROM gpf) AS now, (SELECT CAST(sum(total) AS BIGINT) FROM old) AS was)
SELECT '2024-02-16' AS generated, true AS is_baseline, false AS is_duplicate, CAST(NULL AS VARCHAR) AS previous_last_day, CAST(NULL AS BIGINT) AS delta, CAST(NULL AS DOUBLE) AS ratio,
CAST(NULL AS VARCHAR) AS tide, CAST(NULL AS BIGINT) AS records_broken, CAST(NULL AS VARCHAR) AS broken, CAST(NULL AS VARCHAR) AS model_before, {_lead('old')} AS model_now,
CAST(NULL AS BOOLEAN) AS model_changed, (SELECT arg_max(id, start) FROM so) AS season_id, CAST(NULL AS BOOLEAN) AS season_known, CAST(NULL AS VARCHAR) AS season_before
UNION ALL SELECT '2024-04-02', false, false, (SELECT strftime(max(day), '%Y-%m-%d') FROM old), now - was, round((now - was) / was, 6),
CASE WHEN now = was THEN 'level' WHEN now > was THEN 'rise' ELSE 'narrower' END, (SELECT count(*) FROM b), (SELECT coalesce(string_agg(id, ',' ORDER BY id), '') FROM (FROM b ORDER BY id LIMIT 4)),
{_lead('old')}, {_lead('gpf')}, {_lead('old')} <> {_lead('gpf')}, (SELECT arg_max(id, start) FROM se),
(SELECT arg_max(id, start) FROM se) IN (SELECT id FROM so), (SELECT so.id FROM so WHERE so.start = (SELECT max(start) FROM se)) FROM x""")
def almanac_stories(t):
    """What the stored history says when each of the two snapshots arrives."""
    _, (_, first), (_, second) = _stored(t)
    return first.unionByName(second).drop("scope", "id", "previous_id", "previous_generated")


@query("S11", f"""WITH {_OLD}, {_REC.format(p='cur_', b='gpf')}, {_REC.format(p='old_', b='old')}
SELECT {_id('gpf')} AS exported_from, {_id('old')} AS id, '2024-02-16' AS generated, (SELECT CAST(sum(total) AS BIGINT) FROM old) AS tokens, r.id AS record, r.value, r.achieved FROM old_rec r
UNION ALL SELECT {_id('gpf')}, {_id('gpf')}, '2024-04-02', (SELECT CAST(sum(total) AS BIGINT) FROM gpf), r.id, r.value, r.achieved FROM cur_rec r""")
def almanac_export(t):
    """The stored history of a scope as one JSON object, read back."""
    store, path = _stored(t)[0], shared_dir(t.spark, "almanac-json")
    store.export(SCOPE, path)
    shape = f"exported_from string, snapshots array<struct<id:string,generated:string,tokens:bigint,records:array<{al.RECORD}>>>"
    rows = t.spark.read.schema(shape).json(path).select("exported_from", F.inline("snapshots"))
    return rows.select("exported_from", "id", "generated", "tokens", F.explode("records").alias("r")).select(
        "exported_from", "id", "generated", "tokens", F.col("r.id").alias("record"), "r.value", "r.achieved")
