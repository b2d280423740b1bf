"""Titles and summaries from real files."""

import json

from pyspark.sql import functions as F

from tidemeter.sources import titles


def _log(path, *contents, kind="user"):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [c if isinstance(c, str) and c.startswith("{") else json.dumps({"type": kind, "message": {"content": c}}) for c in contents]
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")


def _found(spark, path, **how):
    return {r["session"]: r["title"] for r in titles.read_titles(spark, str(path), **how).collect()}


def test_first_useful_utterance_of_each_log(spark, tmp_path):
    _log(tmp_path / "a" / "plain.jsonl", "  Größe der\tTabelle   prüfen \nsecond line", "later")
    _log(tmp_path / "a" / "skips.jsonl", "{broken", '{"type":"user"}', '{"type":"user","message":"text"}', "", "<command>run", "CAVEAT: old",
         "ok", [{"type": "image"}], [{"type": "text", "text": ""}, {"type": "text", "text": "second part"}],
         [{"type": "image"}, {"type": "text", "text": "from a list"}], "too late")
    _log(tmp_path / "b" / "long.jsonl", "x" * 200, "short one")
    _log(tmp_path / "b" / "silent.jsonl", "hello there", kind="assistant")
    (tmp_path / "b" / "other.txt").write_text("not a log")
    found = _found(spark, tmp_path)
    assert found == {"plain": "Größe der Tabelle prüfen", "skips": "from a list", "long": "x" * 60, "silent": ""}
    assert _found(spark, tmp_path, max_line_chars=150)["long"] == "short one"
    wanted = spark.createDataFrame([("long",), ("nowhere",)], "session string")
    assert set(_found(spark, tmp_path, sessions=wanted)) == {"long"}


def test_last_path_wins_even_without_a_title(spark, tmp_path):
    _log(tmp_path / "1" / "s.jsonl", "first copy")
    _log(tmp_path / "2" / "s.jsonl", "second copy")
    _log(tmp_path / "1" / "t.jsonl", "only the early one speaks")
    _log(tmp_path / "2" / "t.jsonl", "<command>")
    assert _found(spark, tmp_path) == {"s": "second copy", "t": ""}
    folder = F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1)
    assert set(_found(spark, tmp_path, session=folder)) == {"1", "2"}


def test_summaries_come_first_and_ids_last(spark, tmp_path):
    _log(tmp_path / "logs" / "session-one-1.jsonl", "title one")
    _log(tmp_path / "logs" / "session-two-2.jsonl", "title two")
    side = tmp_path / "side"
    side.mkdir()
    (side / "a.json").write_text(json.dumps({"session-one-1": "early words", "session-two-2": "", "elsewhere": "x"}))
    (side / "b.json").write_text(json.dumps({"session-one-1": "said in short"}))
    (side / "c.json").write_text("[1, 2]")
    (side / "d.json").write_text("{not json")
    rec = spark.createDataFrame([(s,) for s in ("session-one-1", "session-two-2", "session-three-3", "", None, "session-one-1")], "session string")
    label = lambda **k: {r["session"]: r["label"] for r in titles.label_records(spark, rec, str(tmp_path / "logs"), **k).collect()}
    assert label(sidecar=str(side)) == {"session-one-1": "said in short", "session-two-2": "title two", "session-three-3": "session-"}
    assert label(sidecar=str(tmp_path / "missing"))["session-one-1"] == "title one"
    assert label()["session-two-2"] == "title two"
    hidden = titles.label_records(spark, rec, str(tmp_path / "no-such-logs"), sidecar=str(tmp_path / "none"), hidden=True)
    assert all(r["session"] == r["label"] for r in hidden.collect()) and hidden.count() == 3


def test_only_the_first_utterance_of_a_split_is_shuffled(spark, tmp_path):
    _log(tmp_path / "s.jsonl", *[f"utterance {i}" for i in range(50)])
    plan = titles.read_titles(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("try_parse_json") + plan.count("parse_json") <= 2
