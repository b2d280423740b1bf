"""Readers on real files written to a temporary folder."""

import json
from decimal import Decimal

from tidemeter.operators.titles import label_sessions, session_titles, utterances
from tidemeter.plans.mart import UsageMart
from tidemeter.schema import CLAUDE_COUNTERS
from tidemeter.sources import logs, manifest

ZONE = "Asia/Shanghai"


def _write(path, lines, sep="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(sep.join(x if isinstance(x, str) else json.dumps(x) for x in lines).encode())
    return str(path)


def _turn(mid, ts, model="m", session="s", **usage):
    message = {"model": model, "usage": {f"{k}_tokens": v for k, v in usage.items()}}
    if mid:
        message["id"] = mid
    return {"type": "assistant", "timestamp": ts, "sessionId": session, "cwd": "/p", "message": message}


def test_claude_rules(spark, tmp_path):
    ts = "2026-07-01T20:00:00Z"
    _write(tmp_path / "a" / "one.jsonl", [
        _turn("x", ts, input=5, output=1), _turn("x", ts, input=99, output=99),
        _turn(None, ts, input=7), _turn(None, ts, input=7), _turn(None, ts, input=8),
        _turn("y", "bad", input=1), _turn("z", ts, model="<synthetic>", input=1), _turn("w", ts, model="", input=1),
        {"type": "user", "message": {"content": "hi"}}, "[1, 2]", "{broken", "", "   ",
        _turn("n", ts, input=None, output=4),
    ], sep="\r\n")
    _write(tmp_path / "b" / "two.jsonl", [_turn("x", ts, input=3, cache_read_input=4, cache_creation_input=2)])
    got = logs.read_claude(spark, str(tmp_path), ZONE).collect()
    assert sorted(r["total"] for r in got) == [4, 6, 7, 8, 9]
    assert {r["day"].isoformat() for r in got} == {"2026-07-02"} and {r["hour"] for r in got} == {4}
    both = logs.read_claude(spark, str(tmp_path), ZONE, scope="global").collect()
    assert sorted(r["total"] for r in both) == [4, 6, 7, 8]
    reasons = {r["reason"]: r["count"] for r in logs.read_rejects(spark, {"claude": str(tmp_path)}, ZONE).groupBy("reason").count().collect()}
    assert reasons["bad_timestamp"] == 1 and reasons["no_model"] == 2 and reasons["not_json"] >= 1


def test_line_and_file_guards(spark, tmp_path):
    ts = "2026-07-01T00:00:00Z"
    path = _write(tmp_path / "big.jsonl", [_turn("x", ts, input=5), _turn("y", ts, model="m" * 500, input=6)])
    lines = logs.scan_lines(spark, path, "claude")
    rows = logs.classify_claude(lines, ZONE, max_line_chars=400).collect()
    assert sorted((r["reason"], r["total"]) for r in rows if r["reason"]) == [("line_too_long", 0)]
    assert logs.scan_lines(spark, path, "claude", max_file_bytes=10).count() == 0


def test_gemini_totals(spark, tmp_path):
    doc = {"sessionId": "g", "messages": [
        {"type": "gemini", "model": "pro", "timestamp": "2026-07-01T00:00:00Z",
         "tokens": {"input": 10, "output": 2, "cached": 3, "thoughts": 4, "tool": 1, "total": 0}},
        {"type": "gemini", "timestamp": "2026-07-01T01:00:00Z", "tokens": {"input": 1, "total": 50}},
        {"type": "user", "timestamp": "2026-07-01T01:00:00Z"}, {"type": "gemini", "timestamp": None}]}
    _write(tmp_path / "h" / "chats" / "session-1.json", [json.dumps(doc, indent=1)])
    _write(tmp_path / "h" / "other" / "session-2.json", [doc])
    _write(tmp_path / "h" / "chats" / "session-3.json", ["{nope"])
    got = sorted(tuple(r[c] for c in ("model", "input", "output", "cache_read", "total", "session"))
                 for r in logs.read_gemini(spark, str(tmp_path), ZONE).collect())
    assert got == [("gemini-unknown", 1, 0, 0, 50, "g"), ("pro", 10, 6, 3, 20, "g")]


def test_codex_carries_the_model_forward(spark, tmp_path):
    def event(kind, ts="2026-07-01T00:00:00Z", **payload):
        return {"type": "event_msg", "timestamp": ts, "payload": {"type": kind, **payload}}

    def spent(**u):
        return event("token_count", info={"last_token_usage": u})

    _write(tmp_path / "d" / "rollout-1.jsonl", [
        spent(input_tokens=1, output_tokens=1), event("turn_context", model="first"),
        spent(input_tokens=10, output_tokens=2, cached_input_tokens=4, reasoning_output_tokens=3),
        event("turn_context"), spent(input_tokens=1, output_tokens=1, total_tokens=70), event("token_count"),
        event("turn_context", model="second"), spent(input_tokens=2, output_tokens=2)])
    _write(tmp_path / "d" / "rollout-2.jsonl", [spent(input_tokens=5, output_tokens=5)])
    got = sorted((r["model"], r["input"], r["output"], r["total"]) for r in logs.read_codex(spark, str(tmp_path), ZONE).collect())
    assert got == [("codex-unknown", 1, 1, 2), ("codex-unknown", 5, 5, 10), ("first", 1, 1, 70), ("first", 10, 5, 12), ("second", 2, 2, 4)]


def test_carry_forward_survives_file_splits(spark, tmp_path):
    body = []
    for i in range(3000):
        body.append({"type": "event_msg", "timestamp": "2026-07-01T00:00:00Z", "payload": {"type": "turn_context", "model": f"m{i}"}})
        body.append({"type": "event_msg", "timestamp": "2026-07-01T00:00:00Z",
                     "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "output_tokens": 1}}}})
    _write(tmp_path / "rollout-x.jsonl", body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        lines = logs.scan_lines(spark, str(tmp_path), "codex")
        assert lines.rdd.getNumPartitions() > 4
        got = logs.parse_codex(lines, ZONE).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 3000 and all(r["model"] == f"m{r['input']}" for r in got)


def test_read_all_selects_sources(spark, tmp_path):
    _write(tmp_path / "c" / "a.jsonl", [_turn("x", "2026-07-01T00:00:00Z", input=5)])
    paths = {"claude": str(tmp_path / "c"), "codex": str(tmp_path / "missing")}
    assert logs.read_all(spark, paths, ZONE, sources=["claude"]).count() == 1
    assert logs.read_all(spark, paths, ZONE, sources=["nope"]).count() == 0


def test_titles(spark):
    def said(content, kind="user"):
        return json.dumps({"type": kind, "message": {"content": content}})

    rows = [("a", 0, said("<command>")), ("a", 1, said("Caveat: x")), ("a", 2, said("x", "assistant")),
            ("a", 3, said([{"type": "image"}, {"type": "text", "text": "  first   real\nline"}])), ("a", 4, said("later one")),
            ("b", 0, said("ok")), ("b", 1, said('[{"type":"text","text":"quoted"}]')), ("c", 0, "{broken"), ("d", 0, said(None))]
    titles = session_titles(utterances(spark.createDataFrame(rows, "session string, line_no int, value string")))
    assert {r["session"]: r["title"] for r in titles.collect()} == {"a": "first real", "b": '[{"type":"text","text":"quoted"}]'}
    sessions = spark.createDataFrame([("a",), ("b",), ("long-session-id",)], "session string")
    notes = spark.createDataFrame([("b", "summary")], "session string, summary string")
    got = {r["session"]: r["label"] for r in label_sessions(sessions, titles, notes).collect()}
    assert got == {"a": "first real", "b": "summary", "long-session-id": "long-ses"}
    hidden = {r["session"]: r["label"] for r in label_sessions(sessions, titles, notes, hidden=True).collect()}
    assert hidden == {s: s for s in hidden}


def test_refresh_follows_files(spark, tmp_path):
    root, mart = tmp_path / "logs", UsageMart(spark, str(tmp_path / "mart"))
    read = lambda source, files, after: logs.read_claude(spark, str(root), ZONE, files=files, after=after)
    refresh = lambda: mart.refresh_files(logs.list_files(spark, str(root), "claude"), read)
    totals = lambda: sorted((r["day"].isoformat(), r["total"]) for r in mart.records().collect())
    a = root / "a.jsonl"
    _write(a, [_turn("1", "2026-07-01T00:00:00Z", input=1)])
    _write(root / "b.jsonl", [_turn("2", "2026-07-05T00:00:00Z", input=2)])
    assert refresh() == 2 and totals() == [("2026-07-01", 1), ("2026-07-05", 2)]
    assert refresh() == 0
    _write(a, [_turn("1", "2026-07-01T00:00:00Z", input=1), _turn("3", "2026-07-02T00:00:00Z", input=3)])
    (root / "b.jsonl").unlink()
    assert refresh() == 1 and totals() == [("2026-07-01", 1), ("2026-07-02", 3)]
    inventory = manifest.inventory(logs.list_files(spark, str(root), "claude"), logs.MAX_FILE_BYTES).collect()
    assert [(r["source"], r["files"], r["readable"]) for r in inventory] == [("claude", 1, 1)]


def test_batches_are_idempotent(spark, tmp_path):
    from tests.helpers import records

    mart = UsageMart(spark, str(tmp_path / "mart"))
    rec = records(spark, [dict(day="2026-07-01", hour=1, total=5, session="s", project="/p")])
    for batch in (0, 1, 1):
        mart.add_batch(rec, batch)
    assert mart.hours().collect()[0]["total"] == 10
    assert mart.entities("session").collect()[0]["calls"] == 2
    assert mart.try_publish(mart.hours) == "published" and mart.try_publish(mart.hours) == "unchanged"
    assert mart.try_publish(lambda: spark.read.parquet(str(tmp_path / "none"))).startswith("failed")
    assert mart.latest()[0] == 1 and mart.current().where("grain = 'day'").collect()[0]["total"] == 10
    assert Decimal(mart.current().count()) == 3


def test_csv_quoting(spark, tmp_path):
    from tests.helpers import cube
    from tidemeter.operators.periods import period_model
    from tidemeter.sources.sinks import write_period_csv

    rows = cube(spark, [dict(day="2026-07-01", model='say "hi", ok', total=5)])
    write_period_csv(period_model(rows, ["day"]), ['say "hi", ok'], str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text()
    assert text.splitlines() == ['period,total_volume,"say ""hi"", ok",calls', "2026-07-01,5,5,1"]


def test_what_a_counter_is_not_becomes_a_reject(spark, tmp_path):
    def line(i, usage):
        return {"type": "assistant", "timestamp": f"2025-02-01T00:00:{i:02d}Z", "sessionId": "s", "cwd": "/p",
                "message": {"id": f"m{i}", "model": "m", "usage": usage}}

    name = CLAUDE_COUNTERS["input"]
    values = [{name: 7}, {name: 7.0}, {name: 7.5}, {name: "many"}, {name: True}, "none", [1], None, {}, {name: None}]
    _write(tmp_path / "a.jsonl", [line(i, v) for i, v in enumerate(values)])
    good = {r["seq"]: r["total"] for r in logs.read_claude(spark, str(tmp_path), ZONE).collect()}
    assert sorted(good.values()) == [0, 0, 0, 7, 7]
    bad = logs.read_rejects(spark, {"claude": str(tmp_path)}, ZONE).groupBy("reason").count().collect()
    assert {r["reason"]: r["count"] for r in bad} == {"bad_counter": 3, "bad_usage": 2}


def test_guards_are_arguments(spark, tmp_path):
    long = {"type": "assistant", "timestamp": "2025-02-01T00:00:00Z", "sessionId": "s" * 5000, "cwd": "/p",
            "message": {"id": "m", "model": "m", "usage": {CLAUDE_COUNTERS["output"]: 3}}}
    _write(tmp_path / "a.jsonl", [long])
    path = str(tmp_path)
    assert logs.read_claude(spark, path, ZONE).count() == 1
    assert logs.read_claude(spark, path, ZONE, max_line_chars=1000).count() == 0
    assert logs.read_claude(spark, path, ZONE, max_file_bytes=1000).count() == 0
    reasons = lambda **k: [r["reason"] for r in logs.read_rejects(spark, {"claude": path}, ZONE, **k).collect()]
    assert reasons() == [] and reasons(max_line_chars=1000) == ["line_too_long"]
    assert reasons(max_file_bytes={"claude": 1000}) == ["file_too_large"]


def test_a_new_checkpoint_keeps_earlier_batches(spark, tmp_path):
    from tidemeter.streaming import live

    for i in range(2):
        rows = [{"type": "assistant", "timestamp": "2025-02-01T00:00:00Z", "message": {"id": f"m{i}{k}", "model": "m", "usage": "x" if k else {}}} for k in range(3)]
        _write(tmp_path / f"in{i}" / "a.jsonl", rows)
        live.ingest_logs(spark, str(tmp_path / f"in{i}"), "claude", ZONE, str(tmp_path / "out"), str(tmp_path / f"ck{i}")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out-rejects")).where("reason = 'bad_usage'").count() == 4


def test_tables_stored_as_folders_stream(spark, tmp_path):
    from tidemeter.streaming import live

    spark.range(10).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    stream = live.table_stream(spark, str(tmp_path), "t", "id long")
    live.write_rows(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
