"""The queries of this package over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import ready
from .decontaminate import decontaminate
from .exact_dedup import exact_duplicates
from .filter_audit import filter_audit
from .jaccard_join import near_duplicate_groups
from .language import language_id
from .licenses import scan_licenses
from .line_dedup import line_dedup
from .mixing import mixed_order
from .packing import pack
from .periodic_runs import run_digest, with_planted_runs, word_runs
from .quality import quality
from .secrets import scan_secrets
from .sql import SQL
from .toxicity import toxicity


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(table(spark, folder, "documents"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixed_order(table(spark, folder, "documents"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(table(spark, folder, "documents"))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup(table(spark, folder, "documents"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return run_digest(word_runs(with_planted_runs(table(spark, folder, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_exact_dedup,
        op2_secret_scan,
        op3_toxicity,
        op4_ngram_jaccard_join,
        op5_language_id,
        op6_decontamination,
        op7_source_mix,
        op8_quality,
        op9_license_scan,
        op10_line_dedup,
        op11_packing,
        op12_filter_audit,
        op13_periodic_runs,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
