"""Late rows beside stateful streams, over two landings with a restart between."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tests.helpers import records
from tidemeter.schema import RECORD
from tidemeter.streaming import late, live


def _land(spark, path, days):
    rows = [{"day": d, "hour": h, "total": v, "session": "s"} for d, h, v in days]
    records(spark, rows).withColumn("seq", F.col("total")).coalesce(1).write.mode("append").parquet(path)


def test_timed_and_late_are_all_rows(spark, tmp_path):
    src, out, side, check = (str(tmp_path / n) for n in ("in", "out", "late", "ck"))
    stream = lambda: spark.readStream.schema(RECORD).parquet(src)
    run = lambda: late.tumbling_totals(stream(), "1 day", out, side, check, delay="1 day").awaitTermination()
    _land(spark, src, [("2026-03-01", 4, 1), ("2026-03-01", 9, 2), ("2026-03-10", 12, 4)])
    run()
    assert spark.read.parquet(side).count() == 0
    # 8 March closed with the watermark of 9 March, 12:00; 9 March is open still.
    _land(spark, src, [("2026-03-01", 5, 8), ("2026-03-08", 23, 16), ("2026-03-09", 3, 32), ("2026-03-10", 1, 64), ("2026-03-11", 0, 128)])
    run()
    timed = {str(r.start)[:10]: (r.total, r.calls) for r in live.read_updates(spark, out, ["start", "model"]).collect()}
    assert timed == {"2026-03-01": (3, 2), "2026-03-09": (32, 1), "2026-03-10": (68, 2), "2026-03-11": (128, 1)}
    kept = spark.read.parquet(side)
    assert sorted(r.total for r in kept.collect()) == [8, 16] and set(RECORD.names) <= set(kept.columns)
    # A third run without new rows changes nothing.
    run()
    assert spark.read.parquet(side).count() == 2


def test_unique_and_late_messages(spark, tmp_path):
    src, out, side, check = (str(tmp_path / n) for n in ("in", "out", "late", "ck"))
    run = lambda: late.unique_messages(spark.readStream.schema(RECORD).parquet(src), ["seq"], out, side, check, delay="1 day").awaitTermination()
    _land(spark, src, [("2026-03-01", 4, 1), ("2026-03-01", 4, 1), ("2026-03-10", 12, 2)])
    run()
    _land(spark, src, [("2026-03-01", 4, 1), ("2026-03-01", 4, 3), ("2026-03-10", 12, 2), ("2026-03-10", 13, 4), ("2026-03-10", 13, 4)])
    run()
    assert sorted(r.total for r in spark.read.parquet(out).collect()) == [1, 2, 4]
    assert sorted(r.total for r in spark.read.parquet(side).collect()) == [1, 3]


def test_updates_of_two_queries_share_a_target(spark, tmp_path):
    """A new checkpoint counts its batches from 0 again; the later query still has the last word."""
    out = str(tmp_path / "out")
    for i, days in enumerate(([("2026-03-01", 1, 1)], [("2026-03-01", 1, 1), ("2026-03-01", 2, 5)])):
        src = str(tmp_path / f"in{i}")
        _land(spark, src, days)
        stream = live.tumbling_totals(spark.readStream.schema(RECORD).parquet(src), "1 day")
        live.write_updates(stream, out, str(tmp_path / f"ck{i}")).awaitTermination()
    (row,) = live.read_updates(spark, out, ["start", "model"]).collect()
    assert (row.total, row.calls) == (6, 2)


def test_seasons_count_untimed_days(spark, tmp_path):
    src = str(tmp_path / "in")
    start = datetime(2026, 3, 1)
    rows = [{"day": str((start + timedelta(days=d)).date()), "hour": h, "total": v} for d, h, v in ((0, 1, 1), (5, None, 2), (12, 3, 4), (20, None, 8))]
    records(spark, rows).write.parquet(src)
    stream = live.closed(spark.readStream.schema(RECORD).parquet(src), str(tmp_path / "marker"))
    live.write_rows(live.season_sessions(stream), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    found = sorted((str(r.start)[:10], str(r.end)[:10], r.total) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [("2026-03-01", "2026-03-13", 7), ("2026-03-21", "2026-03-21", 8)]
