"""Many small logs in one landed file."""

import json
import os
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from tidemeter.catalog import load
from tidemeter.sources import layouts, logs

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ZONE = "Europe/Berlin"
CATALOG = load()
KEYS = ["source", "ts", "model", "session", "project", "input", "output", "cache_read", "cache_write", "total"]


def _parts(folder):
    return [f for _, _, files in os.walk(folder) for f in files if f.startswith("part-") and f.endswith(".txt")]


@pytest.mark.parametrize("name", [
    "source_inventory", "all_sources_from_files", "streamed_log_ingest", "streamed_rejects", "titles_from_logs", "labels_from_logs",
    "refresh_changed_files", "refresh_after_rule_change", "file_day_index"])
def test_landed_files_do_not_follow_the_number_of_logs(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(sys.modules[CATALOG[name].build.__module__], "shared_dir", lambda _, kind: str(tmp_path / f"{kind}-{uuid.uuid4().hex}"))
    assert difference(CATALOG[name](spark, "/root/testdata/sf0.01"), connect("/root/testdata/sf0.01"), CATALOG[name].sql) is None
    # 300 logs of sf0.01, 50 of the refreshes, 133 of the titles; a task of the three (or, with two landings each, six) writers leaves a file at most.
    assert 0 < len(_parts(tmp_path)) <= 6 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bundles_and_single_files_give_the_same_records(spark, tmp_path):
    builders = {"claude": layouts.claude_lines, "gemini": layouts.gemini_files, "codex": layouts.codex_lines}
    for source, build in builders.items():
        layouts.write_logs(build(spark, ROOT), str(tmp_path / "files" / source))
        layouts.write_bundles(build(spark, ROOT), str(tmp_path / "bundles" / source))
    paths = lambda kind: {s: str(tmp_path / kind / s) for s in builders}
    count = lambda rows: {tuple(r) for r in rows.groupBy(*KEYS).count().collect()}
    single, bundled = (count(logs.read_all(spark, paths(k), ZONE, pattern="part-*", bundled=k == "bundles")) for k in ("files", "bundles"))
    assert single == bundled and single
    reasons = lambda k: {tuple(r) for r in logs.read_rejects(
        spark, paths(k), ZONE, "part-*", bundled=k == "bundles").groupBy("source", "reason").count().collect()}
    assert reasons("files") == reasons("bundles") != set()
    for source in builders:
        sizes = lambda rows: sorted(r["bytes"] for r in rows.collect())
        assert sizes(logs.list_files(spark, str(tmp_path / "files" / source), source, "part-*")) == sizes(
            logs.list_bundled(spark, str(tmp_path / "bundles" / source), source))


def test_guards_and_lines_without_an_envelope(spark, tmp_path):
    turn = lambda i, model="m": json.dumps({
        "type": "assistant", "timestamp": "2026-07-01T00:00:00Z", "message": {"id": f"x{i}", "model": model, "usage": {"input_tokens": i}}})
    pack = lambda log, at, line: json.dumps({"log": log, "at": at, "line": line})
    (tmp_path / "part-0").write_text("\n".join([
        pack("/b.jsonl", 2, turn(1)), pack("/a.jsonl", 0, turn(2, "größe \"q\" \\n\u2028")), turn(16), "{broken"]) + "\n", encoding="utf-8")
    # The same message again, earlier in its log, in another bundle.
    (tmp_path / "part-1").write_text(pack("/b.jsonl", 1, turn(1).replace('"m"', '"first"')) + "\n" + pack("/a.jsonl", 1, None) + "\n")
    path = str(tmp_path)
    got = {(os.path.basename(r.file_path), r.model, r.total) for r in logs.read_claude(spark, path, ZONE, bundled=True).collect()}
    assert got == {("b.jsonl", "first", 1), ("a.jsonl", "größe \"q\" \\n\u2028", 2), ("part-0", "m", 16)}
    assert [r.reason for r in logs.read_rejects(spark, {"claude": path}, ZONE, bundled=True).collect()] == ["not_json"]
    sizes = {os.path.basename(r.file_path): r.bytes for r in logs.list_bundled(spark, path, "claude").collect()}
    assert sizes["a.jsonl"] < sizes["b.jsonl"]
    kept = logs.read_claude(spark, path, ZONE, bundled=True, max_file_bytes=sizes["a.jsonl"])
    assert "b.jsonl" not in {os.path.basename(r.file_path) for r in kept.collect()}
    left = logs.read_rejects(spark, {"claude": path}, ZONE, bundled=True, max_file_bytes={"claude": sizes["a.jsonl"]})
    assert "/b.jsonl" in {r.file_path for r in left.where(F.col("reason") == "file_too_large").collect()}
