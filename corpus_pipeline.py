"""The corpus pipeline: language ID, quality rules, near-duplicates, secrets, packing, in this order.

Each stage keeps the columns of its documents, whatever their names, but for the last, and takes
texts of any length. An empty table comes out empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import langid, packing, quality, secrets, simhash
from tallyforge.llm.common import documents, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that can be told go: no text, no letter, or a low posterior.

    Null keys stay; repeated rows stay or go together; null labels do not train, and without any label
    nothing can be told, so every document goes.
    """
    return langid.accepted(docs, langid.train(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from every language reference go.

    Null and empty texts fail the base rules; null keys stay; repeated rows stay or go together; null
    labels add to no reference, and without references the base rules decide.
    """
    return quality.kept(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays.

    Null ids count as greatest, ties among them go by a hash of the text, and of repeated rows one
    stays. Texts without words, null ones among them, are one group.
    """
    return simhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text, and n_chars follows it.

    Null text stays null, with n_chars null; null sources have no path; repeated rows are masked alike.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents and their places in training sequences.

    Null text is the end id alone; null ids stay null; repeated rows are packed each for itself.
    """
    return packing.best_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Stages hash words, sum over segmentations and pack greedily, which SQL does not express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
