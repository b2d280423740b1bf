"""Arithmetic of volumes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemeter.schema import PARTS


def zero(col: Column) -> Column:
    return F.coalesce(col, F.lit(0).cast("bigint"))


def counter(text: Column) -> Column:
    """A counter's text as a whole number, whole decimals too; null where it is none. Decimals are only tried
    for text that is no plain number."""
    number = text.try_cast("decimal(38,9)")
    whole = number.try_cast("bigint")
    return F.coalesce(text.try_cast("bigint"), F.when(whole == number, whole))


def composition(
    source: Column, total: Column, input_: Column, output: Column, read: Column, write: Column
) -> dict[str, Column]:
    """Split a total into fresh input, output, cache read, cache write and other.

    Each part takes what is left of the total, so the five always add up to
    ``max(0, total)``: a part is the step of the running want, cut off at the total.
    Codex reports cached volume inside its input.
    """
    nothing = F.lit(0).cast("bigint")
    whole = F.greatest(zero(total), nothing)
    fresh = F.when(source == "codex", zero(input_) - zero(read)).otherwise(zero(input_))
    out: dict[str, Column] = {}
    wanted, shown = nothing, nothing
    for name, want in zip(PARTS, (fresh, output, read, write)):
        wanted = wanted + F.greatest(zero(want), nothing)
        reached = F.least(wanted, whole)
        out[name] = reached - shown
        shown = reached
    out[PARTS[-1]] = whole - shown
    return out


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """Ratio with 0 for an empty denominator."""
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), digits)


def share_or_null(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part, whole), digits)
