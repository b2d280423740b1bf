"""Fixed schemas: the canonical record, and the three raw log layouts."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCES = ("claude", "gemini", "codex")
COUNTERS = ("input", "output", "cache_read", "cache_write", "total")
PARTS = ("fresh_part", "output_part", "read_part", "write_part", "other_part")
GRAINS = ("day", "week", "month")

RECORD = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("ts_raw", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("day", T.DateType()),
        T.StructField("hour", T.IntegerType()),
        T.StructField("model", T.StringType()),
        T.StructField("input", T.LongType()),
        T.StructField("output", T.LongType()),
        T.StructField("cache_read", T.LongType()),
        T.StructField("cache_write", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("session", T.StringType()),
        T.StructField("project", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("seq", T.LongType()),
    ]
)

# Counter names of the log formats. Counters and the objects that hold them are read as text,
# so that a value which is not what the format says can be told from a missing one.
CLAUDE_COUNTERS = {
    "input": "input_tokens", "output": "output_tokens",
    "cache_read": "cache_read_input_tokens", "cache_write": "cache_creation_input_tokens",
}
GEMINI_USAGE = "tokens"
GEMINI_COUNTERS = {n: n for n in ("input", "output", "cached", "thoughts", "tool", "total")}
CODEX_COUNTERS = {
    "input": "input_tokens", "cache_read": "cached_input_tokens", "output": "output_tokens",
    "reasoning": "reasoning_output_tokens", "total": "total_tokens",
}

CLAUDE_LINE = """
    type string, timestamp string, sessionId string, cwd string,
    message struct<id string, model string, usage string>,
    _bad string
"""

GEMINI_FILE = f"""
    sessionId string,
    messages array<struct<type string, model string, timestamp string, {GEMINI_USAGE} string>>,
    _bad string
"""

CODEX_LINE = """
    type string, timestamp string,
    payload struct<type string, model string, info struct<last_token_usage string>>,
    _bad string
"""
