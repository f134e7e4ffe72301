"""End to end: recognised regions to canonical documents, for one receipt or a whole table."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.config import Confidence, Extraction
from tallyforge.operators import canonical, extraction, regions, scoring
from tallyforge.operators.dedup import keep_first
from tallyforge.sources.files import IMAGES, UPLOAD_LIMIT


def check_upload(name: str, content: bytes) -> None:
    """Raises ValueError for a wrong suffix, an empty or an oversized file."""
    ending = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    if ending not in IMAGES:
        raise ValueError(f"unsupported file type: {ending or name}")
    if not content:
        raise ValueError("empty file")
    if len(content) > UPLOAD_LIMIT:
        raise ValueError("file too large")


def from_regions(df: DataFrame, extraction_config: Extraction = Extraction(), confidence_config: Confidence = Confidence(), unicode: bool = True) -> DataFrame:
    """``receipt_id, source_file, regions(text, confidence, bbox)`` to canonical documents, as one lazy plan."""
    read = regions.results(df)
    clean = regions.cleaned(read, unicode=unicode).withColumn("lines", regions.lines(F.col("regions"), F.col("cleaned_full_text")))
    found = extraction.extract(clean.select("receipt_id", "lines", "regions"), "lines", extraction_config)
    scored = scoring.score(found, confidence_config)
    return canonical.documents(scored.join(df.select("receipt_id", "source_file"), "receipt_id"))


def from_lines(df: DataFrame, extraction_config: Extraction = Extraction(), confidence_config: Confidence = Confidence()) -> DataFrame:
    """``receipt_id, source_file, lines`` to canonical documents; every line counts as a region of confidence 1.

    The first of each id is kept before the lines are read, while rows are small, and on the key as it
    comes, so that a table dealt by it is not dealt again.
    """
    first = keep_first(df.select("receipt_id", "source_file", "lines"), "receipt_id", "source_file")
    found = extraction.extract(first.withColumn("receipt_id", F.col("receipt_id").cast("string")), "lines", extraction_config)
    found = found.withColumn("regions", F.transform("lines", lambda t: F.struct(t.alias("cleaned_text"), F.lit(1.0).alias("confidence"))))
    return canonical.documents(scoring.score(found, confidence_config), single=True)


def predict_one(spark: SparkSession, receipt_id: str, recognised: list[dict]) -> dict:
    """Prediction for one receipt as a response dictionary."""
    began = time.perf_counter()
    rows = spark.createDataFrame([(receipt_id, receipt_id, [(r["text"], float(r["confidence"]), [[float(v) for v in p] for p in r.get("bbox") or []]) for r in recognised])], "receipt_id string, source_file string, regions " + regions.REGION)
    made = from_regions(rows).first()
    doc = made.asDict(recursive=True) if made else None
    return {
        "status": "success" if doc and doc["_validation"]["status"] == "passed" else "failed", "receipt_id": receipt_id, "prediction": doc, "overall_confidence": doc and doc["overall_confidence"],
        "reliability": doc and doc["reliability"], "review_required": bool(not doc or doc["review_required"]), "processing_time_ms": round(1000 * (time.perf_counter() - began), 2),
    }


def timed(stages: dict[str, Callable[[DataFrame], DataFrame]], df: DataFrame, materialize: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, dict[str, float]]:
    """Runs stages one after another, each written and re-read, and returns their times in milliseconds."""
    took = {}
    for name, stage in stages.items():
        began = time.perf_counter()
        df = materialize(stage(df), name)
        took[name] = round(1000 * (time.perf_counter() - began), 2)
    return df, took
