"""The registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidelog.llm import decontaminate, license_scan, line_dedup, ngram_join, quality_rules, secret_scan, source_mix, span_dedup, token_planes, toxicity
from tidelog.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op1_line_dedup(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.op2_license_scan(table(spark, sf_dir, "documents"))


def op3_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.op3_token_planes(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op4_secret_scan(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op5_quality_rules(table(spark, sf_dir, "documents"))


def op6_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.op6_span_dedup(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op7_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.op8_source_mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op10_ngram_join(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_license_scan": op2_license_scan,
        "op3_token_planes": op3_token_planes,
        "op4_secret_scan": op4_secret_scan,
        "op5_quality_rules": op5_quality_rules,
        "op6_span_dedup": op6_span_dedup,
        "op7_decontaminate": op7_decontaminate,
        "op8_source_mix": op8_source_mix,
        "op9_toxicity": op9_toxicity,
        "op10_ngram_join": op10_ngram_join,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_license_scan": license_scan.OP2_SQL,
        "op5_quality_rules": quality_rules.OP5_SQL,
        "op7_decontaminate": decontaminate.OP7_SQL,
        "op8_source_mix": source_mix.OP8_SQL,
        "op10_ngram_join": ngram_join.OP10_SQL,
    }
