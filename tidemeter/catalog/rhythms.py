"""Hour-of-day queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemeter.catalog.registry import query
from tidemeter.catalog.sql import EV, GP, LN, folded
from tidemeter.functions import calendar as cal
from tidemeter.operators import rhythm as rh

_BAND = "CASE WHEN hour < 6 THEN 'late' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END"


def _sum_if(cond, name):
    return f"CAST(coalesce(sum(total) FILTER ({cond}), 0) AS BIGINT) AS {name}"


@query("A7", f"""
WITH {folded('ev')} SELECT strftime(day, '%Y-%m-%d') AS day, hour, cm AS model, CAST(sum(total) AS BIGINT) AS total
FROM evf WHERE hour IS NOT NULL GROUP BY 1, 2, 3""")
def hourly_by_day_model(t):
    rows = rh.hourly(t.folded("ev", "day hour model"), ["day", "model"])
    return rows.select(cal.iso(F.col("day")).alias("day"), F.col("hour").cast("bigint").alias("hour"), "model", "total")


@query("A7", f"""
WITH {EV}, x AS (SELECT day, h.hour AS hour, CAST(coalesce(sum(total) FILTER (ev.hour = h.hour), 0) AS BIGINT) AS total
FROM ev, range(24) h(hour) WHERE ev.hour IS NOT NULL GROUP BY 1, 2)
SELECT strftime(day, '%Y-%m-%d') AS day, string_agg(total, ',' ORDER BY hour) AS hours FROM x GROUP BY 1""")
def hour_vectors(t):
    rows = rh.hour_vector(rh.hourly(t.cube("ev", "day hour"), ["day"]), ["day"])
    return rows.select(cal.iso(F.col("day")).alias("day"), F.array_join(F.col("hours").cast("array<string>"), ",").alias("hours"))


@query("A16", f"""
WITH {EV}, x AS (SELECT hour, CAST(sum(total) AS BIGINT) AS total FROM ev WHERE hour IS NOT NULL GROUP BY 1)
SELECT (SELECT hour FROM x ORDER BY total DESC, hour LIMIT 1) AS peak_hour, max(total) AS peak_total,
{_sum_if('hour < 6 OR hour >= 22', 'night_volume')}, {_sum_if('hour < 6', 'late_volume')},
{_sum_if('hour BETWEEN 6 AND 11', 'morning_volume')}, {_sum_if('hour BETWEEN 12 AND 17', 'afternoon_volume')},
{_sum_if('hour >= 18', 'evening_volume')} FROM x""")
def peak_night_and_bands(t):
    return rh.rhythm_summary(t.cube("ev", "hour"))


@query("A20", f"""
WITH {EV}, x AS (SELECT hour, CAST(sum(total) AS BIGINT) AS total FROM ev WHERE hour IS NOT NULL GROUP BY 1)
SELECT round(sum(total) FILTER (hour < 6 OR hour >= 22) / sum(total), 6) AS night_index,
round(sum(total) FILTER (hour BETWEEN 6 AND 10) / sum(total), 6) AS morning_index,
round(sum(total) FILTER (hour BETWEEN 9 AND 17) / sum(total), 6) AS work_index,
round(sum(total) FILTER (hour BETWEEN 18 AND 21) / sum(total), 6) AS evening_index,
count(*) FILTER (total > 0) AS active_hours, round(avg(total) FILTER (total > 0), 4) AS active_hour_mean,
max(total) AS peak_hour_total FROM x""")
def hour_share_indices(t):
    return rh.hour_indices(t.cube("ev", "hour"))


@query("A17", f"""
WITH {LN} SELECT CAST(isodow(day) - 1 AS BIGINT) AS weekday, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1""")
def weekday_totals(t):
    return rh.weekday_totals(t.cube("ln", "day"))


@query("A17", f"""
WITH {LN} SELECT CAST(month(day) AS BIGINT) AS month, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1""")
def month_of_year_totals(t):
    return rh.month_totals(t.cube("ln", "day"))


@query("A17", f"""
WITH {LN} SELECT CAST(isodow(day) - 1 AS BIGINT) AS weekday, hour, CAST(sum(total) AS BIGINT) AS total FROM ln GROUP BY 1, 2""")
def weekday_hour_matrix(t):
    return rh.weekday_hour(t.cube("ln", "day hour")).withColumn("hour", F.col("hour").cast("bigint"))


@query("A17", f"""
WITH {folded('ln')} SELECT cm AS model, {_BAND} AS band, CAST(sum(total) AS BIGINT) AS total FROM lnf GROUP BY 1, 2""")
def model_band_matrix(t):
    return rh.model_band(t.folded("ln", "hour model"))


@query("A17", f"""
WITH {EV} SELECT CAST(month(day) AS BIGINT) AS month, {_BAND} AS band, CAST(sum(total) AS BIGINT) AS total
FROM ev WHERE hour IS NOT NULL GROUP BY 1, 2""")
def month_band_matrix(t):
    return rh.month_band(t.cube("ev", "day hour"))


_MATRIX = """
mx AS (SELECT CAST(d AS DATE) AS day, h AS hour FROM generate_series(DATE '{end}' - 13, DATE '{end}', INTERVAL 1 DAY) s(d), range(24) r(h)),
hx AS (SELECT day, hour, CAST(sum(total) AS BIGINT) AS total FROM {base} WHERE hour IS NOT NULL GROUP BY 1, 2),
cells AS (SELECT mx.day, mx.hour, coalesce(hx.total, 0) AS total FROM mx LEFT JOIN hx USING (day, hour)),
lim AS (SELECT min(total) FILTER (total > 0) AS lo, max(total) FILTER (total > 0) AS hi FROM cells)"""


@query("T8 J5", f"""
WITH {GP}, {_MATRIX.format(end='2024-02-28', base='gp')}
SELECT strftime(day, '%Y-%m-%d') AS day, hour, total,
CAST(CASE WHEN total = 0 THEN 0 WHEN hi <= lo THEN 4
  ELSE least(greatest(ceil((total - lo) / (hi - lo) * 4), 1), 4) END AS BIGINT) AS level,
round(coalesce(total / nullif(sum(total) OVER (PARTITION BY day), 0), 0), 6) AS day_share FROM cells, lim""")
def activity_matrix(t):
    return rh.activity_matrix(t.cube("gp", "day hour"), "2024-02-28").withColumn("day", cal.iso(F.col("day")))


@query("T9", f"""
WITH {EV}, {_MATRIX.format(end='2024-01-30', base='ev')}, ph AS (SELECT hour, sum(total) AS total FROM cells GROUP BY 1),
f AS (SELECT CAST(sum(total) AS BIGINT) AS total, {_sum_if('hour < 6 OR hour >= 22', 'night')},
{_sum_if('hour BETWEEN 5 AND 9', 'dawn')}, {_sum_if('hour BETWEEN 17 AND 21', 'dusk')},
count(*) FILTER (total > 0) AS active_hours FROM ph)
SELECT *, CASE WHEN total > 0 AND night > total * 0.42 THEN 'night' WHEN total > 0 AND dawn > total * 0.38 THEN 'dawn'
WHEN total > 0 AND dusk > total * 0.4 THEN 'dusk' WHEN active_hours >= 20 THEN 'all_hours' ELSE 'day' END AS persona FROM f""")
def rhythm_persona(t):
    return rh.persona(rh.activity_matrix(t.cube("ev", "day hour"), "2024-01-30"))


@query("T11", f"""
WITH {EV}, d AS (SELECT day, CAST(sum(total) AS BIGINT) AS total FROM ev GROUP BY 1),
h AS (SELECT hour, CAST(sum(total) AS BIGINT) AS total FROM ev WHERE hour IS NOT NULL GROUP BY 1)
(SELECT 'top_day' AS kind, strftime(day, '%Y-%m-%d') AS member, total FROM d ORDER BY total DESC, day LIMIT 1)
UNION ALL (SELECT 'top_hour', CAST(hour AS VARCHAR), total FROM h ORDER BY total DESC, hour LIMIT 1)""")
def highlights(t):
    return rh.highlights(t.cube("ev", "day hour"))


@query("A22", f"""
WITH {EV}, s AS (SELECT i AS position, TIMESTAMP '2024-01-30 20:00:00' - to_hours(CAST(5 - i AS BIGINT)) AS at FROM range(6) r(i))
SELECT s.position, strftime(s.at, '%Y-%m-%d') AS day, CAST(hour(s.at) AS BIGINT) AS hour,
CAST(coalesce((SELECT sum(total) FROM ev WHERE ev.day = CAST(s.at AS DATE) AND ev.hour = hour(s.at)), 0) AS BIGINT) AS total FROM s""")
def recent_hours(t):
    return rh.recent_hours(t.cube("ev", "day hour"), "2024-01-30 20:41:00").withColumn("day", cal.iso(F.col("day")))
