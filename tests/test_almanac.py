"""The snapshot store on small days."""

import json

import pytest

from tests.helpers import cube, records
from tidemeter.operators import almanac as al
from tidemeter.operators.entities import entity_cube
from tidemeter.plans.almanac import SnapshotStore

DAYS = (("2026-06-29", 100), ("2026-06-30", 120), ("2026-07-01", 130), ("2026-07-10", 200), ("2026-07-11", 220), ("2026-07-21", 300))
SCOPE = al.scope_key(["claude"], zone="Europe/Paris")


MADE: dict = {}


def shot(spark, days=DAYS, generated="2026-07-28", scope=SCOPE, model="m"):
    """A snapshot, summarised once for each content."""
    if (key := (tuple(days), model)) not in MADE:
        rows = [{"day": d, "hour": 10 + i % 3, "total": v, "session": "s", "model": model} for i, (d, v) in enumerate(days)]
        made = al.summarise(cube(spark, rows), entity_cube(records(spark, rows), "session", ["day", "entity"]), "", "")
        (MADE[key],) = (r.asDict(recursive=True) for r in made.collect())
    return spark.createDataFrame([{**MADE[key], "scope": scope, "generated": generated, "updated": generated}], al.SNAPSHOT)


def test_scopes_keep_apart():
    assert len({al.scope_key(), al.scope_key(hidden=True), al.scope_key(until="2026-07-01"), al.scope_key(zone="Asia/Tokyo"), al.scope_key(["b", "a"])}) == 5
    assert al.scope_key(["b", "a"]) == al.scope_key(["a", "b"])


def test_a_snapshot_in_one_row(spark):
    (row,) = shot(spark).collect()
    assert (row.first_day, row.last_day, row.tokens, row.calls, row.models) == ("2026-06-29", "2026-07-21", 1070, 6, {"m": 1070})
    assert [s.id for s in row.seasons] == ["2026-06-29..2026-06-30", "2026-07-01..2026-07-01", "2026-07-10..2026-07-11", "2026-07-21..2026-07-21"]
    kept = {r.id: r for r in row.records}
    assert (kept["peak-day-token"].value, kept["peak-day-token"].achieved, kept["peak-day-token"].precision) == (300.0, "2026-07-21", "exact-day")
    assert kept["peak-hour-token"].detail == "12:00" and kept["max-session-turns"].precision == "range-day"
    # Three days from the first one on: the streak may have begun before the range.
    streak = kept["longest-active-streak"]
    assert (streak.value, streak.achieved, streak.precision, streak.detail) == (3.0, "2026-07-01", "range-boundary", "2026-07-01")
    inner = {r.id: r for r in shot(spark, [("2026-06-20", 5), *DAYS]).collect()[0].records}
    assert inner["longest-active-streak"].precision == "exact-day"


def test_baseline_replay_and_new_records(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    compared, told = store.observe(shot(spark))
    assert {r.status for r in compared.collect()} == {"baseline"}
    (first,) = told.collect()
    assert first.is_baseline and not first.is_duplicate and first.delta is None and first.records_broken is None
    compared, told = store.observe(shot(spark))
    (again,) = told.collect()
    assert again.is_baseline and again.is_duplicate and store.snapshots().count() == 1
    compared, told = store.observe(shot(spark, [*DAYS, ("2026-07-22", 500)], "2026-07-29", model="n"))
    status = {r.id: (r.status, r.prior_value, r.prior_precision) for r in compared.collect()}
    assert status["peak-day-token"] == ("broken", 300.0, "exact-day") and status["max-session-turns"] == ("broken", 6.0, "range-day")
    assert status["longest-active-streak"] == ("standing", 3.0, "range-boundary")
    (second,) = told.collect()
    assert not second.is_baseline and second.previous_last_day == "2026-07-21"
    assert (second.delta, second.ratio, second.tide) == (500, round(500 / 1070, 6), "rise")
    assert second.records_broken == 3 and second.broken == "max-session-turns,peak-day-token,peak-hour-token"
    assert (second.model_before, second.model_now, second.model_changed) == ("m", "n", True)
    assert (second.season_id, second.season_known, second.season_before) == ("2026-07-21..2026-07-22", False, "2026-07-21..2026-07-21")
    # A narrower range breaks nothing, and its season is known.
    _, told = store.observe(shot(spark, DAYS[:-1], "2026-07-30"))
    (third,) = told.collect()
    assert (third.tide, third.records_broken, third.season_known) == ("narrower", 0, True)
    assert {(r.scope, r.generated) for r in store.snapshots().collect()} == {(SCOPE, g) for g in ("2026-07-28", "2026-07-29", "2026-07-30")}


def test_tied_and_historic_records(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.put(shot(spark, [("2026-01-01", 900), ("2026-01-05", 10)]))
    compared, _ = store.observe(shot(spark, [("2026-01-05", 10), ("2026-01-07", 900)], "2026-07-29"))
    assert {r.id: r.status for r in compared.collect()}["peak-day-token"] == "tied"
    compared, _ = store.observe(shot(spark, [("2026-01-05", 10)], "2026-07-30"))
    row = {r.id: r for r in compared.collect()}["peak-day-token"]
    assert (row.status, row.delta, row.prior_achieved) == ("historic", -890.0, "2026-01-01")


def test_retention_by_scope(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), keep=2, scopes=2)
    base = shot(spark, DAYS[:1]).collect()[0].asDict(recursive=True)
    make = lambda *rows: spark.createDataFrame([{**base, "scope": s, "id": i, "generated": g, "updated": g} for s, i, g in rows], al.SNAPSHOT)
    store.put(make(("a", "1", "2026-01-01"), ("b", "1", "2026-01-02")))
    store.put(make(("a", "2", "2026-01-03")))
    store.put(make(("a", "3", "2026-01-04")))
    left = lambda: sorted((r.scope, r.id) for r in store.snapshots().collect())
    assert left() == [("a", "2"), ("a", "3"), ("b", "1")]
    store.put(make(("c", "1", "2026-01-03")))
    assert left() == [("a", "2"), ("a", "3"), ("c", "1")]
    store.put(make(("a", "2", "2026-01-09")))  # the same id again: replaced, not added
    assert sorted((r.id, r.generated) for r in store.snapshots().where("scope = 'a'").collect()) == [("2", "2026-01-09"), ("3", "2026-01-04")]
    store.clear("a")
    assert left() == [("c", "1")]
    store.clear()
    assert left() == []


def test_writers_do_not_lose_each_other(spark, tmp_path):
    one, two = SnapshotStore(spark, str(tmp_path)), SnapshotStore(spark, str(tmp_path))
    one.put(shot(spark, scope="first"))
    raced = []

    def change(old):
        if not raced:  # another writer commits between this one's read and its own commit
            raced.append(two.put(shot(spark, scope="second")))
        return old.unionByName(shot(spark, scope="third"))

    one._commit(change)
    assert sorted(r.scope for r in one.snapshots().collect()) == ["first", "second", "third"]


def test_a_failed_change_leaves_the_version(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.put(shot(spark))
    with pytest.raises(Exception):
        store._commit(lambda old: old.selectExpr("*", "assert_true(false)"))
    assert store.version() == 1 and store.snapshots().count() == 1


def test_export_is_one_object(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.put(shot(spark, DAYS[:2], "2026-07-02"))
    store.put(shot(spark))
    store.put(shot(spark, scope="elsewhere"))
    store.export(SCOPE, str(tmp_path / "out"))
    (line,) = [x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    held = json.loads(line)
    assert held["scope"] == SCOPE and [s["generated"] for s in held["snapshots"]] == ["2026-07-02", "2026-07-28"]
    assert held["snapshots"][1]["models"] == {"m": 1070} and held["exported_from"] == held["snapshots"][1]["id"]
    assert not {"session", "project", "title"} & set(held["snapshots"][0])
