"""Recognised regions: result shapes, extents, confidence filters, and per-receipt results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.operators.cleaning import clean_text, region_extents
from tallyforge.operators.cleaning import status as cleaning_status
from tallyforge.operators.dedup import reading_order

REGION = "array<struct<text:string,confidence:double,bbox:array<array<double>>>>"


def from_parallel(polys: Column, texts: Column, scores: Column) -> Column:
    """Regions of parallel arrays, zipped to the longest: missing text is '', box empty, score 0."""
    z = F.arrays_zip(polys.alias("p"), texts.alias("t"), scores.alias("s"))
    return F.transform(z, lambda x: F.struct(F.coalesce(x["t"], F.lit("")).alias("text"), F.coalesce(x["s"], F.lit(0.0)).cast("double").alias("confidence"), F.coalesce(x["p"], F.array().cast("array<array<double>>")).alias("bbox")))


def from_json(raw: Column) -> Column:
    """Regions of a raw result in any of its shapes: aliases of parallel arrays, an ``ocr`` list, or classic pairs."""
    v = F.try_parse_json(raw)
    first = lambda kind, *names: F.coalesce(*(F.try_variant_get(v, f"$.{n}", kind) for n in names))
    texts = first("array<string>", "rec_texts", "texts", "text")
    parallel = from_parallel(first("array<array<array<double>>>", "dt_polys", "rec_polys", "text_region", "text_regions"), texts, first("array<double>", "rec_scores", "scores", "text_scores"))
    listed = F.try_variant_get(v, "$.ocr", REGION)
    classic = F.transform(
        F.try_variant_get(v, "$", "array<variant>"),
        lambda x: F.struct(F.try_variant_get(x, "$[1][0]", "string").alias("text"), F.try_variant_get(x, "$[1][1]", "double").alias("confidence"), F.try_variant_get(x, "$[0]", "array<array<double>>").alias("bbox")),
    )
    return F.when(texts.isNotNull(), parallel).otherwise(F.coalesce(listed, classic))


def kept(regions: Column, recognition: float = 0.30, detection: float = 0.30) -> Column:
    """Regions with text and a finite score in 0..1 that reaches both thresholds."""
    score = lambda r: V.safe_float(r["confidence"])
    return F.filter(regions, lambda r: F.coalesce((F.trim(r["text"]) != "") & score(r).between(max(recognition, detection), 1.0), F.lit(False)))


def results(df: DataFrame, key: str = "receipt_id", regions: str = "regions") -> DataFrame:
    """Ordered regions, full text and confidence statistics of each receipt."""
    rows = df.select(key, F.posexplode(kept(F.col(regions))).alias("pos", "r"))
    rows = rows.select(key, "pos", F.trim("r.text").alias("text"), "r.confidence", "r.bbox", region_extents(F.col("r.bbox")).alias("e")).select(key, "pos", "text", "confidence", "bbox", "e.*")
    rows = reading_order(rows.na.fill(0.0, ["x_min", "y_min", "height"]), key)
    packed = rows.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("reading_order", "text", "confidence", "bbox"))).alias("regions"), F.round(F.avg("confidence"), 4).alias("mean_confidence"),
        F.min("confidence").alias("min_confidence"), F.count("*").alias("text_region_count"))
    out = df.select(key).join(packed, key, "left").na.fill(0, ["text_region_count"])
    found = F.col("text_region_count") > 0
    return out.withColumn("full_text", F.array_join(F.transform("regions", lambda r: r["text"]), "\n")).withColumn("status", F.when(found, "success").otherwise("failed")).withColumn(
        "warnings", V.codes((~found, "no_text_regions"), (F.col("mean_confidence") < 0.60, "low_mean_confidence")))


def cleaned(df: DataFrame, key: str = "receipt_id", least: int = 1, unicode: bool = True) -> DataFrame:
    """Cleaned regions of each result; the full text becomes that of the surviving regions if there are any."""
    rows = df.select(key, F.posexplode("regions").alias("pos", "r")).select(key, "pos", F.col("r.text").alias("original_text"), F.round("r.confidence", 4).alias("confidence"))
    rows = clean_text(rows, "original_text", unicode, "cleaned_text").where(F.length("cleaned_text") >= least)
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "original_text", "cleaned_text", "confidence", "changes"))).alias("regions"))
    out = clean_text(df.select(key, F.col("full_text").alias("original_full_text")), "original_full_text", unicode, "whole").drop("changes").join(packed, key, "left")
    joined = F.array_join(F.transform("regions", lambda r: r["cleaned_text"]), "\n")
    n = F.coalesce(F.size("regions"), F.lit(0))
    return out.select(key, "original_full_text", F.when(F.size("regions") > 0, joined).otherwise(F.col("whole")).alias("cleaned_full_text"), "regions", F.when(F.size("regions") > 0, n).otherwise(0).alias("cleaned_region_count"),
                      cleaning_status(F.when(F.size("regions") > 0, n).otherwise(0), F.col("whole")).alias("status"))


def lines(regions: Column, full_text: Column, text: str = "cleaned_text") -> Column:
    """Lines for extraction: non-blank region texts in order, else the lines of the full text."""
    own = F.filter(F.transform(regions, lambda r: r[text]), lambda t: F.trim(t) != "")
    return F.when(F.size(own) > 0, own).otherwise(F.filter(F.split(full_text, r"\R"), lambda t: F.trim(t) != ""))
