"""Canonical receipt documents and their schema validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import values as V
from tallyforge.operators.dedup import keep_first

VERSION = "1.0"


def sorted_set(c: Column) -> Column:
    return F.sort_array(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def normal_items(c: Column) -> Column:
    """Items with trimmed names and money prices; nameless ones go, price-less ones stay."""
    named = F.filter(c, lambda x: F.coalesce(F.trim(x["name"]) != "", F.lit(False)))
    return F.transform(named, lambda x: F.struct(F.trim(x["name"]).alias("name"), F.round(F.when(x["price"] >= 0, x["price"]), 2).alias("price"), F.round(V.clip(F.coalesce(x["confidence"], F.lit(0.0))), 4).alias("confidence")))


def price_rollup(prices: Column) -> dict[str, Column]:
    """Sum, count, least and greatest of an array of money, within its row."""
    total = F.aggregate(prices, F.lit(0).cast("decimal(38,2)"), lambda a, x: (a + x).cast("decimal(38,2)"))
    return {"item_sum": total, "items": F.size(prices).cast("bigint"), "least": F.array_min(prices), "greatest": F.array_max(prices)}


def item_warnings(c: Column) -> Column:
    """Positional codes of items that are nameless or whose confidence is out of range."""
    codes = F.transform(c, lambda x, i: V.codes((F.coalesce(F.trim(x["name"]) == "", F.lit(True)), "name_missing"), (x["confidence"].isNotNull() & ~x["confidence"].between(0, 1), "confidence_invalid")))
    return F.flatten(F.transform(codes, lambda ws, i: F.transform(ws, lambda w: F.concat(F.lit("items["), i.cast("string"), F.lit("]_"), w))))


def validation_errors(store: Column, date: Column, total: Column, overall: Column, items: Column, receipt_id: Column) -> Column:
    """Sorted distinct error codes of a canonical document."""
    return F.sort_array(F.array_distinct(V.codes(
        (receipt_id.isNull() | (F.trim(receipt_id) == ""), "receipt_id_missing"),
        (store.isNotNull() & (F.trim(store) == ""), "store_name_empty"),
        (V.date_problem(date).isNotNull(), "date_invalid"),
        ((total < 0) | F.isnan(total), "total_amount_invalid"),
        (overall.isNull() | ~overall.between(0, 1), "overall_confidence_invalid"),
        (items.isNull(), "items_missing"),
        (F.exists(items, lambda x: x["price"] < 0), "item_price_invalid"),
    )))


def documents(df: DataFrame, receipt_id: str = "receipt_id", order: str = "source_file", single: bool = False) -> DataFrame:
    """Canonical documents of scored receipts: normalised, validated, first of each id kept.

    A bad date is a warning and an error at once, so such a document fails validation. ``single``: the
    caller has kept the first of each id already.
    """
    df = df.withColumn("__bad_date", V.date_problem(F.col("transaction_date")))
    total = F.round(F.when(F.col("total_amount") >= 0, F.col("total_amount")), 2)
    df = df.withColumns({
        "store_name": T.display_store(F.col("vendor_name")),
        "date": F.col("transaction_date"),
        "total_amount": total,
        "warnings": sorted_set(F.concat(F.coalesce("warnings", F.array().cast("array<string>")), item_warnings(F.col("items")), F.filter(F.array("__bad_date"), lambda x: x.isNotNull()))),
        "conflicts": sorted_set(F.col("conflicts")),
        "items": normal_items(F.col("items")),
    })
    prices = F.filter(F.transform("items", lambda x: x["price"]), lambda p: p.isNotNull())
    item_sum = F.when(F.size(prices) > 0, F.round(F.aggregate(prices, F.lit(0.0), lambda a, p: a + p), 2))
    errors = validation_errors(F.col("store_name"), F.col("date"), F.col("total_amount"), F.col("overall_confidence"), F.col("items"), F.col(receipt_id))
    df = df.withColumns({
        "metadata": F.struct(F.lit(VERSION).alias("schema_version"), F.col(receipt_id).alias("receipt_id"), F.col(order).alias("source_extraction_file"), F.size("items").alias("item_count"), F.col("expected_item_count"), item_sum.alias("item_sum"),
                             F.round(F.abs(item_sum - F.col("total_amount")), 2).alias("item_total_difference")),
        "_validation": F.struct(F.when(F.size(errors) == 0, "passed").otherwise("failed").alias("status"), errors.alias("errors")),
    })
    out = df.select(receipt_id, order, "store_name", "date", "items", "total_amount", "expected_item_count", "fields", "overall_confidence", "reliability", "review_required", "conflicts", "warnings", "metadata", "_validation")
    return out if single else keep_first(out, receipt_id, order)
