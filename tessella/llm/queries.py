"""One query for each numbered operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import (
    decontaminate,
    lexical,
    licenses,
    packing,
    periodic_runs,
    pii,
    quality,
    secrets,
    simhash,
    suffix_index,
    token_counts,
    token_output,
    toxicity,
)
from tessella.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


def op3_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digest(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"))


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.repeats_digest(table(spark, sf_dir, "documents"))


def op9_seeded_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.rows_digest(table(spark, sf_dir, "documents"))


def op7_toxicity_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_digest(table(spark, sf_dir, "documents"))


def op4_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, sf_dir, "documents"))


def op11_synchronised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_digest(table(spark, sf_dir, "documents"))


def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_heap_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


QUERIES["op1_personal_data"] = op1_personal_data
QUERIES["op3_slack_packing"] = op3_slack_packing
QUERIES["op5_quality_rules"] = op5_quality_rules
SQL["op5_quality_rules"] = quality.quality_sql()
QUERIES["op10_simhash_pivots"] = op10_simhash_pivots
QUERIES["op8_suffix_family"] = op8_suffix_family
QUERIES["op9_seeded_alignment"] = op9_seeded_alignment
QUERIES["op6_token_rows"] = op6_token_rows
QUERIES["op7_toxicity_subwords"] = op7_toxicity_subwords
QUERIES["op2_license_compression"] = op2_license_compression
QUERIES["op4_secret_field"] = op4_secret_field
QUERIES["op11_synchronised_runs"] = op11_synchronised_runs
QUERIES["op12_treap_search"] = op12_treap_search
SQL["op12_treap_search"] = lexical.ranked_sql()
QUERIES["op13_heap_merge_counts"] = op13_heap_merge_counts
