"""Names: models, projects, sessions and titles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"

# Fixed value: a plain tier name, or a tier name in a request model id.
TIER_PATTERN = r"(?i)^(?:claude-)?(opus|sonnet|haiku)(?:-\d[\w.-]*)?$"


def model_or_unknown(model: Column) -> Column:
    return F.coalesce(F.nullif(model, F.lit("")), F.lit(UNKNOWN))


def source_or_unknown(source: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), F.lit(UNKNOWN))


def tier(model: Column) -> Column:
    """Lower-cased tier of a request alias, null for anything else."""
    return F.nullif(F.lower(F.regexp_extract(model, TIER_PATTERN, 1)), F.lit(""))


def resolve_model(model: Column, rules: Iterable[tuple[int, str, str]]) -> Column:
    """Apply ordered ``(ord, needle, backend)`` rules to request aliases.

    Known backends and names that are not a tier stay as logged. The rule list is
    configuration, so it becomes one ordered coalesce instead of a theta join.
    """
    ordered = sorted(rules)
    if not ordered:
        return model
    hits = [F.when(model.contains(needle), F.lit(backend)) for _, needle, backend in ordered]
    known = model.isin(sorted({backend for _, _, backend in ordered}))
    return F.when(known | tier(model).isNull(), model).otherwise(F.coalesce(*hits, model))


def project_label(path: Column) -> Column:
    """Last two path segments, with either slash."""
    segments = F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+$", ""), "/")
    label = F.array_join(F.slice(segments, F.greatest(F.size(segments) - 1, F.lit(1)), 2), "/")
    return F.coalesce(F.nullif(label, F.lit("")), path)


def session_label(session: Column, title: Column | None = None) -> Column:
    short = F.substring(session, 1, 8)
    if title is None:
        return short
    return F.coalesce(F.nullif(title, F.lit("")), short)


def strip(text: Column) -> Column:
    """Unicode-aware strip; plain trim removes spaces only. Text without space at its ends, which is told at a glance,
    is not searched for it."""
    return F.when(text.rlike(r"(?Us)^\S(?:.*\S)?\z"), text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def clean_title(text: Column, max_len: int = 60) -> Column:
    """First line with whitespace collapsed and cut; null when under three characters."""
    first = strip(F.split(strip(text), r"[\r\n]+", 2)[0])
    flat = F.regexp_replace(first, r"(?U)\s+", " ")
    return F.when(F.char_length(flat) >= 3, F.substring(flat, 1, max_len))


def is_title_candidate(text: Column) -> Column:
    """Not empty, not a command envelope, not a caveat notice."""
    body = strip(F.coalesce(text, F.lit("")))
    return (
        (F.char_length(body) > 0)
        & ~body.startswith("<")
        & ~F.lower(body).startswith("caveat")
    )
