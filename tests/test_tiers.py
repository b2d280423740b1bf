"""Runs in tiers, and a mart that publishes touched periods only."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tests.helpers import records
from tidemeter.operators.cube import usage_cube
from tidemeter.operators.registry import folded_cube
from tidemeter.operators.snapshot import snapshot_id
from tidemeter.plans.tiers import RunStore, TieredMart, beside
from tidemeter.sources.sinks import nested_periods


def _merge(rows):
    return rows.groupBy("day").agg(F.sum("total").alias("total"))


def _frame(spark, *pairs):
    return spark.createDataFrame([(date.fromisoformat(d), v) for d, v in pairs], "day date, total long")


def _all(store):
    return {str(r.day): r.total for r in store.read().collect()}


def test_months_beside():
    assert [beside("2024-01", -1), beside("2024-12", 1), beside("2024-05", 1)] == ["2023-12", "2025-01", "2024-06"]


def test_runs_merge_in_tiers_and_sum_up(spark, tmp_path):
    store, want = RunStore(spark, str(tmp_path), _merge, fan=3), {}
    assert store.read() is None
    for i in range(10):
        day = str(date(2024, 1, 1) + timedelta(days=20 * i))
        assert store.add(_frame(spark, (day, i), ("2024-01-01", 1)), "q", i)
        want[day] = want.get(day, 0) + i
        want["2024-01-01"] = want.get("2024-01-01", 0) + 1
        assert not store.add(_frame(spark, (day, 1000)), "q", i)  # a replay
    assert _all(store) == want
    _, held = store.versions.last()
    assert sorted(r["level"] for r in held["runs"]) == [0, 2]
    # One month is read from its own folders in at most a run of each level, whatever came before.
    files = store.read(["2024-06"]).inputFiles()
    assert files and all("p=2024-06" in f for f in files)
    # Nothing but the runs of the kept versions is on disk.
    alive = {r["folder"] for n in store.versions.numbers() for r in store.versions.get(n)["runs"]}
    assert set(store.files.names(f"{tmp_path}/runs")) == alive
    at, _ = store.changed_since(0)
    store.add(_frame(spark, ("2030-05-05", 7)), "another query", 0)
    assert store.changed_since(at)[1] == ["2030-05"]
    assert store.add(_frame(spark).where("false"), "q", 10) and not store.add(_frame(spark, ("2024-01-01", 9)), "q", 10)


def test_writers_do_not_lose_each_other(spark, tmp_path):
    one, two = RunStore(spark, str(tmp_path), _merge), RunStore(spark, str(tmp_path), _merge)
    plain, raced = one.versions.follow, []

    def follow(number, document):
        if not raced:
            raced.append(two.add(_frame(spark, ("2024-01-02", 5)), "other", 0))
        return plain(number, document)

    one.versions.follow = follow
    assert one.add(_frame(spark, ("2024-01-01", 1)), "q", 0)
    assert _all(one) == {"2024-01-01": 1, "2024-01-02": 5}


def _published(mart):
    rows = mart.current().select("grain", "period", "total", "calls", F.map_entries("models").alias("m")).collect()
    return {(r.grain, r.period, r.total, r.calls, tuple(sorted(map(tuple, r.m)))) for r in rows}


def _whole(spark, rows):
    found = nested_periods(folded_cube(usage_cube(records(spark, rows)))).select("grain", "period", "total", "calls", F.map_entries("models").alias("m"))
    return {(r.grain, r.period, r.total, r.calls, tuple(sorted(map(tuple, r.m)))) for r in found.collect()}


def test_only_touched_periods_are_published(spark, tmp_path):
    mart, rows = TieredMart(spark, str(tmp_path), fan=2), []
    make = lambda *days: [{"day": d, "hour": 3, "total": v, "session": "s", "project": "p", "model": "ab"[i % 2]} for i, (d, v) in enumerate(days)]

    def step(number, batch):
        rows.extend(batch)
        mart.add_batch(records(spark, batch), "q", number)
        return mart.publish()

    assert step(0, make(("2024-01-10", 1), ("2024-01-11", 2), ("2024-02-28", 4), ("2024-04-30", 8))) == "published"
    first = mart.versions.last()[1]["parts"]
    assert set(first) == {"2024-01", "2024-02", "2024-04"} and _published(mart) == _whole(spark, rows)
    # 1 May lies in the week of 29 April: April's part is written again, the earlier ones are not.
    assert step(1, make(("2024-05-01", 16), ("2024-05-20", 32))) == "published"
    second = mart.versions.last()[1]["parts"]
    assert second["2024-01"] == first["2024-01"] and second["2024-02"] == first["2024-02"] and second["2024-04"] == second["2024-05"] != first["2024-04"]
    assert _published(mart) == _whole(spark, rows)
    assert mart.snapshot() == snapshot_id(usage_cube(records(spark, rows))).collect()[0]["snapshot_id"]
    # The same batch again, and nothing new, change nothing.
    mart.add_batch(records(spark, make(("2024-05-01", 999))), "q", 1)
    assert mart.publish() == "unchanged" and _published(mart) == _whole(spark, rows)


def test_new_seats_name_all_periods_anew(spark, tmp_path):
    mart, rows = TieredMart(spark, str(tmp_path), fan=4), []
    for number in range(2):
        batch = [{"day": f"2024-0{1 + number}-{10 + i}", "hour": 1, "total": 10 + i, "session": "s", "model": f"m{i + 6 * number}"} for i in range(6)]
        rows += batch
        mart.add_batch(records(spark, batch), "q", number)
        assert mart.publish() == "published"
    parts = mart.versions.last()[1]["parts"]
    assert parts["2024-01"] == parts["2024-02"] and len(mart.seats()) == 7
    assert _published(mart) == _whole(spark, rows)
    assert mart.models.read().count() == 12
