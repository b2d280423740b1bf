"""Small record frames for golden cases."""

from datetime import datetime

from pyspark.sql import functions as F

from tidemeter.operators.cube import usage_cube
from tidemeter.schema import RECORD


def records(spark, rows):
    """Rows are dicts; ``day`` is required, missing fields are null, ``hour`` makes a timestamp."""
    out = []
    for i, r in enumerate(rows):
        day = datetime.fromisoformat(r["day"])
        hour = r.get("hour")
        ts = day.replace(hour=hour) if hour is not None else None
        out.append((
            r.get("source", "claude"), r.get("ts_raw", ts.isoformat() if ts else "not-a-time"), ts, day.date(), hour,
            r.get("model", "a"), r.get("input"), r.get("output"), r.get("cache_read"), r.get("cache_write"),
            r.get("total", 0), r.get("session"), r.get("project"), r.get("file_path", "f"), 0, i))
    return spark.createDataFrame(out, RECORD)


def cube(spark, rows, keys=("day", "hour", "source", "model")):
    return usage_cube(records(spark, rows), keys)


def days(spark, totals):
    """(day, total) pairs as a day table."""
    return spark.createDataFrame(list(totals.items()), "d string, total bigint").select(
        F.to_date("d").alias("day"), "total")


def row(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
