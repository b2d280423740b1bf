"""DuckDB twins of the table adapters, as named subqueries."""

from __future__ import annotations

_EVENT_BODY = """
{name}0 AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, user_id // 3 AS u,
    CASE user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'gemini' ELSE 'codex' END AS source,
    event_id % 97 = 0 AS bad, {when} AS w
  FROM events),
{name}1 AS (
  SELECT *, CAST(w AS DATE) AS day,
    CASE WHEN k % 40 <> 39 THEN CAST(round(value * 100) AS BIGINT) END AS input,
    CASE WHEN k % 25 <> 24 THEN k * 5 + 3 END AS output,
    CASE WHEN k % 10 <> 9 THEN k * 7 END AS cache_read,
    CASE WHEN source <> 'claude' THEN 0 WHEN k % 50 <> 49 THEN k * 2 END AS cache_write
  FROM {name}0),
{name} AS (
  SELECT source, day, input, output, cache_read, cache_write, event_id AS seq,
    CASE WHEN NOT bad THEN w END AS ts,
    CASE WHEN NOT bad THEN CAST(hour(w) AS BIGINT) END AS hour,
    CASE WHEN bad THEN 'not-a-time' ELSE strftime(w, '%Y-%m-%dT%H:%M:%S.%f') END AS ts_raw,
    CASE WHEN event_id % 101 <> 0 THEN event_type END AS model,
    CASE source
      WHEN 'claude' THEN coalesce(input,0)+coalesce(output,0)+coalesce(cache_read,0)+coalesce(cache_write,0)
      WHEN 'gemini' THEN coalesce(input,0)+coalesce(output,0)+coalesce(cache_read,0)+k
      ELSE coalesce(input,0)+coalesce(output,0) END AS total,
    CASE WHEN source <> 'codex'
      THEN 's' || user_id || '-' || strftime(date_trunc('week', day), '%Y%m%d') END AS session,
    CASE WHEN source = 'claude' AND u % 12 <> 11
      THEN '/srv/team' || (u % 5) || '/app' || (u % 12) END AS project
  FROM {name}1)"""

EV = _EVENT_BODY.format(name="ev", when="ts")
GP = _EVENT_BODY.format(
    name="gp",
    when="ts + to_days(CAST(3 * (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4)"
    " + 7 * (date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 11) AS INTEGER))",
)
LN = """
ln0 AS (
  SELECT *, CASE l_returnflag WHEN 'A' THEN 'claude' WHEN 'N' THEN 'gemini' ELSE 'codex' END AS source,
    CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice) AS BIGINT) AS input,
    CAST(l_partkey % 24 AS BIGINT) AS hour
  FROM lineitem),
ln1 AS (
  SELECT *, qty * 10 AS output, CAST(round(l_discount * 1000) AS BIGINT) * qty * 5 AS cache_read,
    CASE WHEN source = 'claude' THEN CAST(round(l_tax * 100) AS BIGINT) * qty ELSE 0 END AS cache_write
  FROM ln0),
ln AS (
  SELECT source, l_shipdate + to_hours(hour) AS ts, CAST(l_shipdate AS DATE) AS day, hour,
    strftime(l_shipdate + to_hours(hour), '%Y-%m-%dT%H:%M:%S.%f') AS ts_raw,
    'brand-' || (l_partkey % 25) AS model, input, output, cache_read, cache_write,
    CASE source WHEN 'claude' THEN input + output + cache_read + cache_write
      WHEN 'gemini' THEN input + output + cache_read ELSE input + output END AS total,
    'o' || l_orderkey AS session, '/plant' || (l_suppkey % 10) || '/bay' || l_suppkey AS project,
    l_orderkey * 8 + l_linenumber AS seq
  FROM ln1)"""

BASE = {"ev": EV, "gp": GP, "ln": LN}


def folded(name: str) -> str:
    """Registry slots of all records and ``{name}f`` with ``cm``, the folded model."""
    return f"""{BASE[name]},
reg0 AS (
  SELECT coalesce(nullif(model, ''), 'unknown') AS model,
    min(CASE WHEN ts IS NOT NULL THEN '0' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
             ELSE '1' || strftime(day, '%Y-%m-%d') END) AS fk,
    max(strftime(day, '%Y-%m-%d') || CASE WHEN ts IS NULL THEN '0'
             ELSE '1' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END) AS lk
  FROM {name} GROUP BY 1),
reg1 AS (
  SELECT *, row_number() OVER (ORDER BY fk, model) AS rn,
    row_number() OVER (ORDER BY lk DESC, model DESC) AS rr
  FROM reg0 WHERE model <> 'other'),
slots AS (
  SELECT model, row_number() OVER (ORDER BY rn) - 1 AS slot FROM reg1
  WHERE CASE WHEN (SELECT rn FROM reg1 WHERE rr = 1) <= 7 THEN rn <= 7 ELSE rn <= 6 OR rr = 1 END),
{name}f AS (
  SELECT b.*, coalesce(s.model, 'other') AS cm
  FROM {name} b LEFT JOIN slots s ON coalesce(nullif(b.model, ''), 'unknown') = s.model)"""




def parts(source_cte: str, name: str = "pt") -> str:
    """Composition waterfall of a record subquery."""
    return f"""
{name}0 AS (SELECT *, greatest(coalesce(total,0),0) AS t,
    greatest(CASE WHEN source='codex' THEN coalesce(input,0)-coalesce(cache_read,0)
             ELSE coalesce(input,0) END, 0) AS wf FROM {source_cte}),
{name}1 AS (SELECT *, least(wf, t) AS fresh_part FROM {name}0),
{name}2 AS (SELECT *, least(greatest(coalesce(output,0),0), t-fresh_part) AS output_part FROM {name}1),
{name}3 AS (SELECT *, least(greatest(coalesce(cache_read,0),0), t-fresh_part-output_part) AS read_part FROM {name}2),
{name}4 AS (SELECT *, least(greatest(coalesce(cache_write,0),0), t-fresh_part-output_part-read_part) AS write_part FROM {name}3),
{name} AS (SELECT *, t-fresh_part-output_part-read_part-write_part AS other_part FROM {name}4)"""


def grains(alias: str = "day") -> str:
    """Lateral expansion of a day to its three periods."""
    return (
        f"(SELECT 'day' AS grain, CAST({alias} AS DATE) AS period UNION ALL "
        f"SELECT 'week', CAST(date_trunc('week', {alias}) AS DATE) UNION ALL "
        f"SELECT 'month', CAST(date_trunc('month', {alias}) AS DATE))"
    )
