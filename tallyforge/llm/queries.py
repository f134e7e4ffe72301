"""The registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import bpe, chunks, dac, html, langid, licenses, packing, quality, secrets, simhash
from tallyforge.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.document_fingerprints(documents(spark, sf_dir))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_token_files(*dac.write_token_files(documents(spark, sf_dir)))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_report(documents(spark, sf_dir))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_document_fingerprints, op2_bpe_round_trip, op3_best_fit_packing, op4_quality_rules, op5_secret_scan,
    op6_language_id, op7_license_scan, op8_token_files, op9_simhash_near_duplicates, op10_main_text)}
#: No query here is SQL-expressible as a whole; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {}
