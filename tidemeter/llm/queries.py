"""Registered queries of the package: thin digests of the operators over their whole tables, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemeter.llm import decontaminate, jaccard, linedup, packing, periodicity, pii, quality, substrings, suffixes, tokencounts, topk, toxicity, vectorcodes
from tidemeter.llm.common import load


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(load(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(load(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.report(load(spark, sf_dir, "documents"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(load(spark, sf_dir, "documents"))


def op8_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.report(load(spark, sf_dir, "documents"))


def op9_linedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.report(load(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(load(spark, sf_dir, "documents"))


def op11_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodicity.report(load(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.report(load(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_substrings, op3_toxicity, op4_packing, op5_topk, op6_jaccard, op7_suffixes, op8_tokencounts, op9_linedup, op10_pii, op11_periodicity, op12_quality, op13_vectorcodes)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontaminate": decontaminate.ORACLE_SQL, "op2_substrings": substrings.ORACLE_SQL, "op5_topk": topk.ORACLE_SQL, "op6_jaccard": jaccard.ORACLE_SQL, "op9_linedup": linedup.ORACLE_SQL, "op13_vectorcodes": vectorcodes.ORACLE_SQL}
