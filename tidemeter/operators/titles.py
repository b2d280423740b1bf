"""Session titles from the first useful user utterance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.functions import labels
from tidemeter.operators.dedup import first_per_key
from tidemeter.operators.once import once


def utterances(lines: DataFrame) -> DataFrame:
    """User lines with their text: plain content, or the first text part of a list.

    ``lines`` is (session, line_no, value). The variant keeps string and list content apart.
    """
    v = once(lines.select("session", "line_no", "value"), v=F.try_parse_json("value"))
    users = v.where(F.try_variant_get("v", "$.type", "string") == "user").select(
        "session", "line_no", F.try_variant_get("v", "$.message.content", "variant").alias("c"))
    users = once(users, kind=F.schema_of_variant("c"))
    kind = F.col("kind")
    part = F.from_json(F.to_json("c"), "array<struct<type string, text string>>")
    first_text = F.get(F.filter(part, lambda p: p["type"] == "text"), F.lit(0))["text"]
    return users.select(
        "session", "line_no",
        F.when(kind == "STRING", F.try_variant_get("c", "$", "string"))
        .when(kind.startswith("ARRAY"), first_text).alias("text"))


def session_titles(spoken: DataFrame) -> DataFrame:
    """(session, title). Cleaning comes first, so at most sixty characters are shuffled."""
    cleaned = once(spoken.where(labels.is_title_candidate(F.col("text"))), title=labels.clean_title(F.col("text"))).where("title is not null")
    return first_per_key(cleaned, ["session"], ["line_no"]).select("session", "title")


def label_sessions(
    sessions: DataFrame, titles: DataFrame, summaries: DataFrame | None = None, hidden: bool = False
) -> DataFrame:
    """Session label: sidecar summary, else title, else the short id.

    Pseudonymised reports set ``hidden``: the alias in ``session`` is then its own label.
    """
    if hidden:
        return sessions.withColumn("label", F.col("session"))
    out = sessions.join(titles, "session", "left")
    choices = [F.nullif("title", F.lit(""))]
    if summaries is not None:
        out = out.join(summaries.select("session", "summary"), "session", "left")
        choices.insert(0, F.nullif("summary", F.lit("")))
    return out.withColumn("label", F.coalesce(*choices, labels.session_label(F.col("session")))).select(
        *sessions.columns, "label")
