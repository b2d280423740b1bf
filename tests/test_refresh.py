"""File-level refresh: what is parsed, read and rewritten."""

import json
import os
from datetime import date

import pytest

from tidemeter.plans.mart import UsageMart
from tidemeter.schema import CLAUDE_COUNTERS
from tidemeter.sources import logs, manifest

ZONE = "UTC"


def _write(path, *turns):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps({
        "type": "assistant", "timestamp": f"{day}T10:00:00Z", "sessionId": path.stem, "cwd": "/p",
        "message": {"id": f"{path.stem}-{i}", "model": "sonnet", "usage": {CLAUDE_COUNTERS["output"]: n}}}) + "\n" for i, (day, n) in enumerate(turns)) or "{}\n")


def _refresh(spark, mart, src, rules=(), **how):
    read = lambda source, files, after: logs.read_claude(spark, src, ZONE, rules, files=files, after=after)
    return mart.refresh_files(logs.list_files(spark, src, "claude"), read, rules, **how)


def test_only_touched_days_are_read_and_written(spark, tmp_path):
    src, mart = tmp_path / "in", UsageMart(spark, str(tmp_path / "mart"))
    _write(src / "a.jsonl", ("2026-03-01", 1), ("2026-03-02", 2))
    _write(src / "b.jsonl", ("2026-03-02", 4))
    _write(src / "c.jsonl", ("2026-03-05", 8))
    _write(src / "silent.jsonl")
    assert _refresh(spark, mart, str(src)) == 4
    days = {os.path.basename(r.file_path): r.days for r in mart.index().collect()}
    assert days == {"a.jsonl": [date(2026, 3, 1), date(2026, 3, 2)], "b.jsonl": [date(2026, 3, 2)], "c.jsonl": [date(2026, 3, 5)], "silent.jsonl": []}
    plan = mart.records([date(2026, 3, 2)])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [p#" in plan.replace("isnotnull(p", "p#") and "2026-03-02" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    untouched = tmp_path / "mart" / "records" / "p=2026-03-05"
    before = {f: os.stat(untouched / f).st_mtime_ns for f in os.listdir(untouched)}
    # One file grows into a new day, one goes: its only other day keeps the rows of the first file.
    _write(src / "a.jsonl", ("2026-03-01", 1), ("2026-03-02", 2), ("2026-03-03", 16))
    (src / "b.jsonl").unlink()
    assert _refresh(spark, mart, str(src)) == 1
    assert {(str(r.day), r.total) for r in mart.records().collect()} == {("2026-03-01", 1), ("2026-03-02", 2), ("2026-03-03", 16), ("2026-03-05", 8)}
    assert {f: os.stat(untouched / f).st_mtime_ns for f in os.listdir(untouched)} == before
    assert not any((tmp_path / "mart" / "staging").iterdir())


def test_a_vanished_day_leaves_no_folder(spark, tmp_path):
    src, mart = tmp_path / "in", UsageMart(spark, str(tmp_path / "mart"))
    _write(src / "a.jsonl", ("2026-03-01", 1))
    _write(src / "b.jsonl", ("2026-03-02", 2))
    _refresh(spark, mart, str(src))
    (src / "b.jsonl").unlink()
    assert _refresh(spark, mart, str(src)) == 0
    assert [str(r.day) for r in mart.records().collect()] == ["2026-03-01"]
    assert sorted(p.name for p in (tmp_path / "mart" / "records").glob("p=*")) == ["p=2026-03-01"]


def test_rules_and_reader_versions_parse_again(spark, tmp_path):
    src, mart = tmp_path / "in", UsageMart(spark, str(tmp_path / "mart"))
    _write(src / "a.jsonl", ("2026-03-01", 1))
    _write(src / "b.jsonl", ("2026-03-02", 2))
    rules = [(1, "sonnet", "pool")]
    steps = [_refresh(spark, mart, str(src), r, **how) for r, how in (((), {}), ((), {}), (rules, {}), (rules, {}), (rules, {"reader": logs.READER_VERSION + 1}))]
    assert steps == [2, 0, 2, 0, 2] and {r.model for r in mart.records().collect()} == {"pool"}
    assert manifest.rules_version([(2, "a", "b"), (1, "c", "d")]) == manifest.rules_version([(1, "c", "d"), (2, "a", "b")]) != manifest.rules_version([])


def test_a_failed_refresh_is_repeated(spark, tmp_path):
    src, mart = tmp_path / "in", UsageMart(spark, str(tmp_path / "mart"))
    _write(src / "a.jsonl", ("2026-03-01", 1))
    with pytest.raises(ZeroDivisionError):
        mart.refresh_files(logs.list_files(spark, str(src), "claude"), lambda *_: 1 / 0)
    assert mart.records().count() == 0 and not any((tmp_path / "mart" / "staging").iterdir())
    assert _refresh(spark, mart, str(src)) == 1 and mart.records().count() == 1
