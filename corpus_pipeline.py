"""A corpus from raw documents to packed sequences: five stages, each over all that its predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns the next table,
which is written as Parquet and read again. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemeter.llm import decontaminate, jaccard, linedup, packing, toxicity
from tidemeter.llm.common import load, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on the labelled ones among ``documents``, rejects go."""
    machine = toxicity.train(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return toxicity.clean(docs, machine)


#: Words from which a repeated run of lines is cut.
LINE_WORDS = 25


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that an earlier document or line holds are cut; ``n_chars`` follows. A document of which no
    word is left goes; one that had none before stays."""
    made = linedup.dedup(docs, LINE_WORDS).where("not (n_removed > 0 and text rlike r'\\A[\\x20\\x09-\\x0D]*\\z')")
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


#: Words of a shingle and least similarity in per cent of near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect, the one with the smallest id stays."""
    return jaccard.distinct(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot train or apply the toxicity machine; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
