"""Field coverage, freshness and capability grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemeter.functions import calendar as cal
from tidemeter.functions.volumes import share
from tidemeter.operators.cube import COVERAGE

# Grade limits and the field behind each capability.
RECENT_DAYS = 3
OK_RATIO = 0.85
FULL = {"valid_ts": 0.95, "with_project": 0.7, "with_session": 0.7, "with_components": 0.9}
TREND_TS, TREND_ENTITY = 0.9, 0.25


def provenance(cube: DataFrame) -> DataFrame:
    """Coverage counts overall and per source in one grouping-sets pass over the cube."""
    agg = [F.sum("calls").alias("records"), F.sum("total").alias("total"),
           *[F.sum(c).alias(c) for c in COVERAGE],
           cal.iso(F.min("day")).alias("first_day"), cal.iso(F.max("day")).alias("last_day")]
    sets = cube.groupingSets([[F.col("source")], []], F.col("source")).agg(*agg)
    return sets.withColumn("source", F.coalesce("source", F.lit("all")))


def overall(provenance_rows: DataFrame) -> DataFrame:
    return provenance_rows.where("source = 'all'")


def freshness(provenance_rows: DataFrame, generated: str, until: str | None = None) -> DataFrame:
    """How old the last data day is at generation time."""
    age = F.greatest(F.datediff(F.lit(generated).cast("date"), F.to_date("last_day")), F.lit(0)).cast("bigint")
    state = F.lit("range") if until else (
        F.when(F.col("last_day").isNull(), "stale").when(age == 0, "fresh")
        .when(age <= RECENT_DAYS, "recent").otherwise("stale"))
    return overall(provenance_rows).select("last_day", age.alias("age_days"), state.alias("freshness"))


def health(provenance_rows: DataFrame) -> DataFrame:
    """Grade of the records for entity and trend analysis."""
    r = {c: share(F.col(c), F.col("records")) for c in FULL}
    full = r["valid_ts"] >= FULL["valid_ts"]
    for c in ("with_project", "with_session", "with_components"):
        full = full & (r[c] >= FULL[c])
    trend = (r["valid_ts"] >= TREND_TS) & (
        (r["with_project"] >= TREND_ENTITY) | (r["with_session"] >= TREND_ENTITY))
    return overall(provenance_rows).select(
        *[v.alias(f"{k}_ratio") for k, v in r.items()],
        F.when(F.col("records") == 0, "base").when(full, "full").when(trend, "trend").otherwise("base").alias("grade"))


def capabilities(provenance_rows: DataFrame, replay: DataFrame) -> DataFrame:
    """Status of each analysis by the share of records that can feed it."""
    row = overall(provenance_rows).withColumn(
        "replay_retained", replay.select("replay_retained").scalar())
    n = F.greatest("records", F.lit(1).cast("bigint"))
    ratios = {
        "project": F.col("with_project"), "session": F.col("replay_retained"), "rhythm": F.col("valid_ts"),
        "reuse": F.col("with_components"), "flow": F.greatest("with_project", "with_session"),
    }
    long = row.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("capability"), share(v, n).alias("ratio")) for k, v in ratios.items()
    ])).alias("c")).select("c.*")
    return long.withColumn("status", F.when(F.col("ratio") >= OK_RATIO, "ok").when(F.col("ratio") > 0, "partial").otherwise("off"))


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("rows"))
