"""Golden cases with hand-computed answers."""

import base64
import hashlib
import hmac
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.helpers import cube, days, records, row
from tidemeter.functions import calendar as cal
from tidemeter.functions import labels, pseudonym
from tidemeter.functions.volumes import composition
from tidemeter.operators import compare as cp
from tidemeter.operators import entities as en
from tidemeter.operators import milestones as ms
from tidemeter.operators import modes as md
from tidemeter.operators import periods as pe
from tidemeter.operators import quality as ql
from tidemeter.operators import registry as rg
from tidemeter.operators import rhythm as rh
from tidemeter.operators import seasons as ss
from tidemeter.operators import sequence as sq
from tidemeter.operators import turns as tn
from tidemeter.operators.cube import in_range
from tidemeter.operators.snapshot import snapshot_id
from tidemeter.schema import PARTS


@pytest.mark.parametrize("source,total,inp,out,read,write,want", [
    ("claude", 275, 140, 60, 45, 30, [140, 60, 45, 30, 0]),
    ("gemini", 96, 50, 25, 16, 0, [50, 25, 16, 0, 5]),
    ("codex", 210, 160, 35, 70, 0, [90, 35, 70, 0, 15]),
    ("unknown", 18, 7, 4, 0, 0, [7, 4, 0, 0, 7]),
    ("claude", 64, 90, 12, 5, 0, [64, 0, 0, 0, 0]),
    ("codex", 23, 8, 6, 31, 0, [0, 6, 17, 0, 0]),
    ("claude", -9, 2, 2, 2, 2, [0, 0, 0, 0, 0]),
])
def test_composition(spark, source, total, inp, out, read, write, want):
    cols = [F.lit(source)] + [F.lit(v).cast("bigint") for v in (total, inp, out, read, write)]
    got = row(spark.range(1).select(*[c.alias(n) for n, c in composition(*cols).items()]))
    assert [got[p] for p in PARTS] == want
    assert sum(want) == max(0, total)


def _mode_rows():
    def day(d, models, hours, cache=0, project="p"):
        """``hours`` are (hour, model, value); cache sits on the first row."""
        return [dict(day=f"2025-03-{d:02d}", hour=h, model=m, total=v, cache_read=cache if i == 0 else 0, project=project)
                for i, (h, m, v) in enumerate(hours)]

    # Just off each limit of the rules: volume, models, neighbouring hours, multiple of the median, cache share.
    out = day(11, "x", [(15, "x", 640)])
    out += day(12, "xyz", [(6, m, 700) for m in "xyz"])
    out += day(13, "x", [(h, "x", 900) for h in (13, 14, 15)])
    out += day(14, "x", [(h, "x", 260) for h in range(0, 24, 3)])
    out += day(15, "x", [(h, "x", 640) for h in range(2, 20, 2)])
    out += day(16, "x", [(4, "x", 3000)], cache=1200)
    out += day(17, "xy", [(5, "x", 900), (20, "y", 2600)])
    return out


def test_work_modes(spark):
    rec = records(spark, _mode_rows())
    classified = md.classify(md.daily_features(cube(spark, _mode_rows()), en.entity_cube(rec, "project")))
    got = {r["day"].isoformat(): r["mode"] for r in classified.collect()}
    want = ["insufficient", "explore", "deep", "cruise", "sprint", "cache", "deep"]
    assert [got[f"2025-03-{d}"] for d in range(11, 18)] == want


def test_work_mode_model_filter_applies_first(spark):
    rows = [r for r in _mode_rows() if r["model"] == "x"]
    classified = md.classify(md.daily_features(cube(spark, rows), en.entity_cube(records(spark, rows), "project")))
    got = {r["day"].isoformat(): (r["total"], r["mode"]) for r in classified.collect()}
    assert got["2025-03-17"] == (900, "insufficient")


def test_season_boundaries(spark):
    totals = {"2025-03-30": 40, "2025-03-31": 45, "2025-04-02": 50, "2025-04-09": 60, "2025-04-17": 70, "2025-04-18": 75}
    got = ss.seasons(cube(spark, [dict(day=d, total=v) for d, v in totals.items()])).orderBy("season").collect()
    assert [(r["start"].isoformat(), r["end"].isoformat()) for r in got] == [
        ("2025-03-30", "2025-03-31"), ("2025-04-02", "2025-04-09"), ("2025-04-17", "2025-04-18")]


def test_season_character(spark):
    steady = [dict(day=f"2026-01-{d:02d}", total=100, model="a") for d in range(1, 7)]
    moved = [dict(day=f"2026-02-{d:02d}", total=100, model="b") for d in range(1, 7)]
    surge = [dict(day=f"2026-03-{d:02d}", total=1000 if d == 6 else 1, model="b") for d in range(1, 7)]
    got = ss.seasons(cube(spark, steady + moved + surge)).orderBy("season").collect()
    assert [r["character"] for r in got] == ["steady", "migration", "surge"]


def test_records_and_ratio_floor(spark):
    rows = [dict(day="2026-07-01", total=100, cache_read=100), dict(day="2026-07-02", total=2000, cache_read=1000),
            dict(day="2026-07-21", total=3000, cache_read=0)]
    table = ss.record_days(cube(spark, rows), tn.running_max_turns(cube(spark, rows), en.entity_cube(records(spark, rows), "session")))
    got = {r["id"]: (r["value"], r["achieved"].isoformat()) for r in ss.personal_records(table).collect()}
    assert got["peak-cache-ratio"] == (0.5, "2026-07-02")
    assert got["peak-day-token"] == (3000.0, "2026-07-21")
    assert got["longest-active-streak"] == (2.0, "2026-07-02")


def test_record_status(spark):
    schema = "generated string, id string, value double, achieved string"
    history = spark.createDataFrame([
        ("g1", "a", 5.0, "d1"), ("g1", "b", 5.0, "d1"), ("g2", "c", 5.0, "d1"), ("g1", "c", 5.0, "d0"), ("g1", "d", 9.0, "d1")], schema)
    now = spark.createDataFrame([("a", 6.0, "d9"), ("b", 5.0, "d2"), ("c", 5.0, "d0"), ("d", 8.0, "d1"), ("e", 1.0, "d1")],
                                "id string, value double, achieved string")
    got = {r["id"]: r["status"] for r in ss.against_history(now, history).collect()}
    assert got == {"a": "broken", "b": "tied", "c": "standing", "d": "historic", "e": "baseline"}


def test_history_keeps_latest(spark):
    rows = [(f"s{s}", f"s{s}-{i:02d}", f"2026-01-{i:02d}" if s else f"2025-01-{i:02d}", i) for s in range(10) for i in range(1, 31)]
    schema = "scope string, id string, generated string, v int"
    fresh = spark.createDataFrame([("s5", "s5-30", "2026-01-30", 999)], schema)
    got = ss.upsert_history(spark.createDataFrame(rows, schema), fresh).collect()
    assert len(got) == 8 * 24 and "s0" not in {r["scope"] for r in got}
    assert [r["v"] for r in got if r["id"] == "s5-30"] == [999]
    assert min(r["generated"] for r in got) == "2026-01-07"


def test_trend_open_day_and_gaps(spark):
    t = row(sq.trend(days(spark, {"2025-05-11": 40, "2025-05-12": 70, "2025-05-13": 130, "2025-05-14": 2}), "2025-05-14"))
    assert (t["complete_days"], t["growth_streak"], t["decline_streak"], t["avg7"], t["avg30"], t["momentum"]) == (3, 2, 0, 80, 80, 0)
    fortnight = {f"2025-05-{d:02d}": 60 if d < 8 else 150 for d in range(1, 15)}
    t = row(sq.trend(days(spark, fortnight), "2025-05-15", since="2025-05-01"))
    assert (t["avg7"], t["momentum"]) == (150, 1.5)
    t = row(sq.trend(days(spark, {"2025-05-01": 90, "2025-05-03": 240}), "2025-05-04", since="2025-05-01"))
    assert (t["complete_days"], t["avg7"], t["growth_streak"]) == (3, 110, 1)
    t = row(sq.trend(days(spark, {"2025-05-12": 80, "2025-05-13": 30}), "2025-05-14", until="2025-05-13"))
    assert (t["complete_days"], t["decline_streak"]) == (2, 1)


def _window(spark, generated, grain, totals, until=None):
    changes = cp.attribution(cube(spark, [dict(day=d, hour=3, total=v) for d, v in totals.items()]), grain, generated, until)
    return cp.window_delta(changes).collect()


def test_equivalent_window(spark):
    totals = {"2026-06-01": 50, "2026-06-02": 50, "2026-06-20": 900, "2026-07-01": 100, "2026-07-02": 100, "2026-07-03": 777}
    got = _window(spark, "2026-07-03", "month", totals)[0]
    assert (got["mode"], got["current"], got["previous"], got["change_pct"]) == ("elapsed", 200, 100, 100.0)
    got = _window(spark, "2026-09-01", "month", {"2026-06-05": 400, "2026-07-05": 500})[0]
    assert (got["mode"], got["change_pct"]) == ("full", 25.0)
    assert _window(spark, "2026-07-03", "day", {"2026-07-02": 1, "2026-07-03": 5}) == []
    assert _window(spark, "2026-07-01", "month", {"2026-06-05": 400, "2026-07-01": 500}) == []


def test_change_folding(spark):
    rows = [dict(day="2026-01-05", model=f"m{i}", total=100) for i in range(8)]
    rows += [dict(day="2026-02-05", model=f"m{i}", total=100 + 10 * i) for i in range(8)]
    got = cp.fold_changes(cp.attribution(cube(spark, rows), "month", "2026-05-01")).orderBy("rank").collect()
    assert [(r["model"], r["delta"]) for r in got] == [("m7", 70), ("m6", 60), ("m5", 50), ("m4", 40), ("m3", 30), ("rest", 30)]


def test_interval_needs_adjacent_complete_periods(spark):
    rows = cube(spark, [dict(day=f"2026-{m:02d}-03", total=m) for m in (1, 2, 3, 4, 6)])
    ok = cp.interval_comparison(rows, "month", "2026-12-01", "2026-01-01", "2026-02-01", "2026-03-01").collect()
    assert [(r["previous"], r["current"]) for r in ok] == [(3, 7)]
    run = lambda *a, **k: cp.interval_comparison(rows, "month", *a, **k).count()
    assert run("2026-12-01", "2026-01-01", "2026-02-01", "2026-04-01") == 0  # gap inside B
    assert run("2026-12-01", "2026-02-01", "2026-03-01", "2026-03-01") == 0  # B inside A
    assert run("2026-12-01", "2026-03-01", "2026-04-01", "2026-06-01") == 0  # B too short
    assert run("2026-04-15", "2026-01-01", "2026-02-01", "2026-03-01") == 0  # April still open


def test_compare_refuses_mixed_kinds(spark):
    with pytest.raises(ValueError):
        cp.compare(spark.range(1), ("model", "a"), ("project", "b"))


def test_forecast(spark):
    rows = cube(spark, [dict(day="2026-07-01", total=100), dict(day="2026-07-10", total=200)])
    got = row(cp.month_forecast(rows, "2026-07-10"))
    assert (got["forecast"], got["progress"]) == (930, 32)
    assert cp.month_forecast(rows, "2026-07-31").count() == 0
    assert cp.month_forecast(rows, "2026-07-10", until="2026-07-09").count() == 0


def test_running_max_turns(spark):
    rows = [dict(day="2026-07-01", session="s")] * 2 + [dict(day="2026-07-02", session="s")] * 3 + [dict(day="2026-07-03")]
    got = tn.running_max_turns(cube(spark, rows), en.entity_cube(records(spark, rows), "session")).orderBy("day").collect()
    assert [r["max_turns"] for r in got] == [2, 5, 5]


def test_replay_keeps_the_last_200(spark):
    rows = [dict(day="2026-07-01", hour=1, ts_raw=f"2026-07-01T00:{i // 60:02d}:{i % 60:02d}", session="s", total=i) for i in range(250)]
    rec = records(spark, rows)
    counts = row(tn.replay_counts(en.entity_cube(rec, "session", ["entity"])))
    assert (counts["replay_eligible"], counts["replay_retained"]) == (250, 200)
    got = tn.replay(rec).orderBy("turn").collect()
    assert [r["total"] for r in got] == list(range(50, 250))
    assert got[-1]["running"] == sum(range(50, 250)) and got[-1]["running_share"] == 1.0


def test_provenance_counts(spark):
    full = dict(input=1, output=1, cache_read=0, cache_write=0, session="s", project="/p")
    rows = [dict(day="2026-07-01", hour=1, total=100, **full), dict(day="2026-07-02", hour=2, total=200, **full),
            dict(day="2026-07-03", total=40, **full)]
    got = row(ql.overall(ql.provenance(cube(spark, rows))))
    assert (got["records"], got["total"], got["valid_ts"], got["with_components"]) == (3, 340, 2, 3)


def test_components_must_share_a_record(spark):
    rows = [dict(day="2026-07-01", input=1, output=1), dict(day="2026-07-01", input=1, output=1, cache_read=0, cache_write=0)]
    got = row(ql.overall(ql.provenance(cube(spark, rows))))
    assert (got["with_input"], got["with_components"]) == (2, 1)


@pytest.mark.parametrize("generated,until,want", [
    ("2026-07-01", None, "fresh"), ("2026-07-04", None, "recent"), ("2026-07-05", None, "stale"), ("2026-07-09", "2026-07-01", "range")])
def test_freshness(spark, generated, until, want):
    rows = ql.provenance(cube(spark, [dict(day="2026-07-01", total=1)]))
    assert row(ql.freshness(rows, generated, until))["freshness"] == want


def _nine_models():
    return [dict(day=f"2026-07-{i + 1:02d}", hour=1, model=f"model-{i}", total=i + 1) for i in range(9)]


def test_registry_overflow(spark):
    base = cube(spark, _nine_models())
    slots = {r["model"]: r["slot"] for r in rg.registry(base).collect()}
    assert slots == {**{f"model-{i}": i for i in range(6)}, "model-8": 6}
    other = rg.folded_cube(base).where("model = 'other'").agg(F.sum("total")).collect()[0][0]
    assert other == 7 + 8


def test_registry_ignores_order_and_range(spark):
    rows = _nine_models()
    random.Random(3).shuffle(rows)
    want = sorted(map(tuple, rg.slot_table(cube(spark, _nine_models())).collect()))
    assert sorted(map(tuple, rg.slot_table(cube(spark, rows)).collect())) == want
    latest = row(rg.latest_backend(cube(spark, rows), until="2026-07-08"))
    assert (latest["latest_backend"], latest["raw_model"], latest["folded"]) == ("other", "model-7", True)


def test_registry_prefers_valid_times(spark):
    rows = [dict(day="2026-07-01", model="dated"), dict(day="2026-07-05", hour=1, model="timed"), dict(day="2026-07-09", hour=1, model="other")]
    got = {r["model"]: r["slot"] for r in rg.slot_table(cube(spark, rows)).collect()}
    assert got == {"timed": 0, "dated": 1, "other": 7}


def test_top_models_tie_break(spark):
    rows = [dict(day="2026-07-01", model=m, total=v) for m, v in (("c", 5), ("b", 9), ("a", 5), ("d", 5))]
    assert [r["model"] for r in pe.top_models(cube(spark, rows)).collect()] == ["b", "a", "c"]


def test_snapshot_id_depends_on_content_only(spark):
    rows = [dict(day=f"2026-07-0{d}", hour=d, model=m, total=d) for d in range(1, 6) for m in "ab"]
    ident = lambda r: row(snapshot_id(cube(spark, r)))["snapshot_id"]
    base = ident(rows)
    assert ident(list(reversed(rows))) == base and len(base) == 24
    assert ident(rows + [dict(day="2026-07-09", total=1)]) != base
    wide = in_range(cube(spark, rows + [dict(day="2026-07-09", total=1)]), None, "2026-07-05")
    assert row(snapshot_id(wide))["snapshot_id"] == base


def test_streaks_and_quiet_tail(spark):
    d = days(spark, {"2026-07-01": 1, "2026-07-02": 1, "2026-07-03": 0, "2026-07-05": 1, "2026-07-06": 1, "2026-07-07": 1})
    got = row(sq.streaks(d, "2026-07-07"))
    assert (got["current"], got["longest"], got["longest_end"].isoformat()) == (3, 3, "2026-07-07")
    assert row(sq.streaks(d, "2026-07-08"))["current"] == 0
    assert tuple(row(sq.quiet_tail(d, "2026-07-10"))) == ("quiet", 3)
    assert tuple(row(sq.quiet_tail(days(spark, {"2026-07-01": 0}), "2026-07-10"))) == ("none", 0)


def test_milestones_cross_several_at_once(spark):
    got = sq.milestone_crossings(days(spark, {"2026-07-01": 500, "2026-07-02": 20000})).orderBy("milestone").collect()
    assert [(r["day"].isoformat(), r["milestone"]) for r in got] == [("2026-07-02", 1000), ("2026-07-02", 10000)]


def test_relay_needs_unique_adjacent_leaders(spark):
    rows = [dict(day="2026-07-01", model="a", total=5), dict(day="2026-07-02", model="b", total=5),
            dict(day="2026-07-03", model="a", total=5), dict(day="2026-07-03", model="b", total=5),
            dict(day="2026-07-04", model="a", total=5), dict(day="2026-07-06", model="b", total=5)]
    got = sq.relays(sq.daily_leader(cube(spark, rows))).collect()
    assert [(r["day"].isoformat(), r["from_model"], r["to_model"]) for r in got] == [("2026-07-02", "a", "b")]


def test_activity_levels(spark):
    rows = [dict(day="2026-07-14", hour=h, total=v) for h, v in ((1, 10), (2, 20), (3, 30), (4, 40), (5, 50))]
    m = rh.activity_matrix(cube(spark, rows), "2026-07-14")
    assert m.count() == 14 * 24
    got = {r["hour"]: r["level"] for r in m.where("total > 0").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4}
    flat = rh.activity_matrix(cube(spark, [dict(day="2026-07-14", hour=1, total=9)]), "2026-07-14")
    assert row(flat.where("total > 0"))["level"] == 4


@pytest.mark.parametrize("status,totals", [
    ("warming", [100, 100, 100, 100, 113]), ("steady", [100, 100, 100, 100, 111]), ("cooling", [100, 87]),
    ("warming", [0, 0, 5]), ("steady", [0, 0, 0]), ("unknown", [7])])
def test_usage_status(spark, status, totals):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(totals)], "period int, total bigint")
    assert row(cp.usage_status(rows))["status"] == status


@pytest.mark.parametrize("name,want", [
    ("claude-opus-3-7", "pool-l"), ("claude-instant-2", "claude-instant-2"), ("pool-s", "pool-s"),
    ("sonnet", "pool-m"), ("our-haiku-proxy", "our-haiku-proxy"), ("claude-haiku-2-1", "pool-s")])
def test_alias_rules(spark, name, want):
    rules = [(9, "sonnet", "pool-m"), (2, "opus", "pool-l"), (7, "haiku", "pool-s")]
    got = row(spark.range(1).select(labels.resolve_model(F.lit(name), rules).alias("m")))
    assert got["m"] == want


def test_alias_first_rule_wins_and_no_rules(spark):
    both = [(2, "opus", "second"), (1, "opus", "first")]
    got = row(spark.range(1).select(labels.resolve_model(F.lit("opus"), both).alias("a"), labels.resolve_model(F.lit("opus"), []).alias("b")))
    assert tuple(got) == ("first", "opus")


@pytest.mark.parametrize("path,want", [
    ("/home/me/app", "me/app"), ("C:\\work\\app\\", "work/app"), ("solo", "solo"), ("/", "/"), ("a/b", "a/b")])
def test_project_label(spark, path, want):
    assert row(spark.range(1).select(labels.project_label(F.lit(path)).alias("l")))["l"] == want


@pytest.mark.parametrize("text,want", [
    ("  hello   big\tworld \nsecond", "hello big world"), ("\u2003wide\u2003gap\u2003", "wide gap"), ("ab", None), ("x" * 80, "x" * 60)])
def test_clean_title(spark, text, want):
    assert row(spark.range(1).select(labels.clean_title(F.lit(text)).alias("t")))["t"] == want


@pytest.mark.parametrize("text,day,hour", [
    ("2026-07-01T23:30:00Z", "2026-07-02", 1), ("2026-07-01T23:30:00+02:00", "2026-07-01", 23), ("2026-07-01T05:00:00", "2026-07-01", 5),
    ("2026-01-01T23:30:00.123456Z", "2026-01-02", 0), ("2026-07-01", "2026-07-01", 0), ("not-a-time", None, None),
    ("2026-13-01T00:00:00Z", None, None), ("", None, None), (None, None, None)])
def test_local_time(spark, text, day, hour):
    c = F.lit(text).cast("string")
    got = row(spark.range(1).select(cal.iso(cal.local_day(c, "Europe/Berlin")).alias("d"), cal.local_hour(c, "Europe/Berlin").alias("h")))
    assert tuple(got) == (day, hour)


@pytest.mark.parametrize("value", ["/home/me/project", "ü-ñ-你好", "x" * 300])
def test_pseudonym_is_hmac(spark, value):
    key = b"k" * 100
    digest = hmac.new(key, f"usage/project/v1\0{value}".encode(), hashlib.sha256).digest()
    want = "Project-" + base64.b32encode(digest).decode()[:10]
    assert row(spark.range(1).select(pseudonym.pseudonym(key, "project", F.lit(value)).alias("p")))["p"] == want
    full = row(spark.range(1).select(pseudonym.token(key, "project", F.lit(value), 52).alias("p")))["p"]
    assert full == base64.b32encode(digest).decode().rstrip("=")


def test_pseudonyms_stay_apart_when_codes_collide(spark, monkeypatch):
    monkeypatch.setattr(pseudonym, "LENGTH", 2)
    values = spark.range(3000).select(F.concat(F.lit("v"), "id").alias("v"))
    got = pseudonym.alias_table(values, "v", b"key", "session").collect()
    assert len({r["alias"] for r in got}) == 3000
    assert {len(r["alias"]) - len("Session-") for r in got} >= {4}


@pytest.mark.parametrize("values", [[5], [1, 2], [3, 1, 2], [7, 7, 7, 7], [0, 2**22, 2**45, 2**45 + 1], list(range(101)),
                                    [random.Random(1).randrange(2**50) for _ in range(500)]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert row(en.exact_median(df, "v"))["median"] == statistics.median(values)


def test_ladders(spark):
    rows = ms.ladders(spark).collect()
    by = {}
    for r in rows:
        by.setdefault(r["metric"], []).append((r["rung"], r["target"], r["tier"]))
    total = sorted(by["total"])
    assert len(total) == 72 and total[0] == (0, 1000.0, "bronze") and total[-1] == (71, 1e14, "prismatic")
    assert len(by["sessions"]) == 48 and sorted(by["sessions"])[:3] == [(0, 1.0, "bronze"), (1, 1.0, "bronze"), (2, 1.0, "bronze")]
    assert len({t for _, t, _ in by["sessions_per_day"]}) == len(by["sessions_per_day"])
    assert [t for _, t, _ in sorted(by["cache_ratio"])][-5:] == [0.975, 0.98, 0.99, 0.995, 0.999]


def test_window_start(spark):
    got = row(spark.range(1).select(*[cal.iso(pe.window_start(m, "2026-07-15", n)).alias(m) for m, n in (("day", 14), ("week", 8), ("month", 6))]))
    assert tuple(got) == ("2026-07-02", "2026-05-25", "2026-02-01")


def test_pseudonymised_totals_equal_raw_totals(spark):
    rows = [dict(day="2026-07-01", session=f"s{i % 3}", total=i) for i in range(9)]
    rec = records(spark, rows)
    hidden = rec.withColumn("session", pseudonym.pseudonym(b"k", "session", F.col("session")))
    totals = lambda r: sorted(x["total"] for x in en.entity_totals(en.entity_cube(r, "session", ["entity"])).collect())
    assert totals(rec) == totals(hidden)
    assert not {x["entity"] for x in en.entity_cube(hidden, "session", ["entity"]).collect()} & {"s0", "s1", "s2"}


def test_hidden_totals_keep_colliding_entities_apart(spark, monkeypatch):
    from tidemeter.catalog.ingest import hidden_totals

    monkeypatch.setattr(pseudonym, "LENGTH", 2)
    rec = records(spark, [{"day": "2026-01-01", "session": f"s{i % 200}", "total": 1 + i % 200} for i in range(400)])
    got = hidden_totals(rec, "session", b"key").collect()
    assert len({r.alias for r in got}) == 200 and sorted(r.total for r in got) == [2 * i for i in range(1, 201)]
    assert max(len(r.alias) for r in got) > 10
