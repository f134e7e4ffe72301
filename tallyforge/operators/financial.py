"""Trusted financial summary: records, duplicate flags, exclusion reasons, and money totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import Financial
from tallyforge.functions import text as T
from tallyforge.functions import values as V
from tallyforge.operators.dedup import flag_repeats


def records(df: DataFrame, config: Financial = Financial()) -> DataFrame:
    """Flat records of raw documents.

    Input: receipt_id, source_file, store_name, date, total_amount, overall_confidence,
    review_required and validation_status, all as text (null where missing); optional ``malformed``
    (array of codes that a reader found). Output adds the normalised values and ``errors``.
    """
    parsed = F.struct(
        T.squeeze(F.col("store_name")).alias("shown"), T.bare_store(F.col("store_name")).alias("bare_store"), V.bare_amount(F.col("total_amount")).alias("bare_total"),
        V.safe_float(F.col("overall_confidence")).alias("conf"), V.to_bool(F.col("review_required")).alias("review_required"), (F.col("date").isNull() | V.date_problem(F.col("date")).isNull()).alias("date_valid"),
    )
    kept = ["receipt_id", "source_file", "date", "total_amount", "overall_confidence", "validation_status", *(["malformed"] if "malformed" in df.columns else [])]
    # generated from a one-row array: each text is parsed once, as no later filter or column is merged into it
    df = df.select(*kept, F.inline(F.array(parsed)))
    df = df.select(*kept, "shown", "bare_store", "conf", "review_required", "date_valid", F.inline(F.array(F.struct(V.bare_money(F.col("bare_total")).alias("total")))))
    conf, total, status = F.col("conf"), F.col("total"), F.col("validation_status")
    valid = F.col("overall_confidence").isNull() | (conf.isNotNull() & conf.between(0, 1))
    malformed = F.col("malformed") if "malformed" in df.columns else F.array().cast("array<string>")
    checks = V.codes(
        (F.lit(config.require_validation) & status.isNull(), "validation_status_missing"),
        (F.lit(config.require_validation) & (status != "passed"), "validation_failed"),
        (~F.col("date_valid"), "invalid_date"),
        (F.col("total_amount").isNotNull() & total.isNull(), "invalid_total"),
        (~valid, "invalid_confidence"),
    )
    errors = F.sort_array(F.array_distinct(F.concat(checks, malformed)))
    row = F.struct(
        F.when(F.col("shown") != "", F.col("shown")).alias("store_name"),
        F.coalesce(F.when(F.col("bare_store") != "", F.col("bare_store")), F.lit(T.UNKNOWN_STORE)).alias("store_key"),
        "date", "total",
        F.col("total_amount").isNull().alias("missing_total"),
        (F.col("total_amount").isNotNull() & total.isNull()).alias("invalid_total"),
        F.when(valid, F.coalesce(conf, F.lit(0.0))).otherwise(0.0).alias("confidence"),
        valid.alias("confidence_valid"),
        F.col("overall_confidence").isNull().alias("confidence_missing"),
        "review_required", "date_valid", errors.alias("errors"),
    )
    out = df.select("receipt_id", "source_file", F.inline(F.array(row)))
    has = lambda code: F.array_contains("errors", code)
    kind = F.when(has("validation_failed"), "validation_failed").when(has("validation_status_missing"), "validation_status_missing").when(has("schema_invalid"), "schema_invalid").otherwise("valid")
    return out.withColumn("classification", kind).withColumn("schema_valid", F.size("errors") == 0)


def decided(df: DataFrame, config: Financial = Financial()) -> DataFrame:
    """Records with duplicate flags, ordered exclusion reasons, the primary reason and ``included``."""
    df = flag_repeats(records(df, config), "receipt_id")
    kind = F.col("classification")
    reasons = V.codes(
        (F.col("duplicate"), "duplicate_receipt_id"),
        (kind == "validation_failed", "validation_failed"),
        (kind == "validation_status_missing", "validation_status_missing"),
        (~F.col("schema_valid") & ~kind.isin("validation_failed", "validation_status_missing"), "schema_invalid"),
        (F.col("missing_total"), "missing_total"),
        (F.col("invalid_total"), "invalid_total"),
        (F.lit(config.exclude_review) & F.col("review_required"), "review_required"),
        (~F.col("confidence_valid"), "invalid_confidence"),
        (F.col("confidence_valid") & (F.col("confidence") < config.minimum_confidence), "low_confidence"),
    )
    df = df.withColumn("reasons", reasons)
    return df.withColumn("primary_reason", F.get("reasons", F.lit(0))).withColumn("included", F.size("reasons") == 0)


def spend_per_store(decided_: DataFrame) -> DataFrame:
    """Exact spend and count by canonical store; the shown name is that of the first file."""
    return (
        decided_.where("included and total is not null")
        .groupBy("store_key")
        .agg(F.min_by("store_name", "source_file").alias("store_name"), F.sum("total").cast(V.MONEY).alias("spend"), F.count("*").alias("transactions"))
    )


def ranked(spend: DataFrame) -> DataFrame:
    """Stores by falling spend, then name ignoring case. One row per store, dealt into ranges of spend.

    The rank is the row's place in its range plus the rows of the ranges before it, so no single task
    holds all stores. A row's range is a function of its spend alone (cuts at quantiles, one number
    per range on the driver), so the count of a range and its rows agree however the plan is run.
    """
    from pyspark.sql.window import Window

    parts = int(spend.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amount = F.col("spend").cast("double")
    cuts = sorted(set(spend.select(amount.alias("x")).approxQuantile("x", [i / parts for i in range(1, parts)], 0.1 / parts)), reverse=True)
    at = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        at = F.when(amount >= cut, i).otherwise(at)
    rows = spend.withColumn("__range", at)
    sizes = rows.groupBy("__range").agg(F.count("*").alias("__n"))
    before = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(F.desc("spend"), F.lower("store_name"), "store_key"))
    return rows.withColumn("__place", place).join(F.broadcast(before), "__range").withColumn("rank", F.col("__place") + F.col("__before")).drop("__range", "__place", "__before")


def totals(decided_: DataFrame) -> DataFrame:
    """One row over trusted totals: sum, count, average (half up), exact median, least and greatest."""
    t = F.col("total")
    rows = decided_.where("included and total is not null")
    out = rows.agg(F.sum(t).alias("s"), F.count("*").alias("n"), F.median(t).alias("m"), F.min(t).alias("lo"), F.max(t).alias("hi"))
    zero = F.lit(0).cast(V.MONEY)
    return out.select(
        F.coalesce(F.col("s").cast(V.MONEY), zero).alias("total_spend"), F.col("n").alias("transaction_count"),
        F.coalesce(F.try_divide("s", "n").cast(V.MONEY), zero).alias("average_spend"), F.coalesce(F.col("m").cast("decimal(38,4)").cast(V.MONEY), zero).alias("median_spend"),
        F.col("lo").alias("minimum_spend"), F.col("hi").alias("maximum_spend"),
    )


def counters(decided_: DataFrame, config: Financial = Financial()) -> DataFrame:
    """One row of audit counts. A missing confidence is not counted as low; an invalid one is."""
    return decided_.agg(
        F.count("*").alias("loaded"),
        F.count_if("included").alias("included"),
        F.count_if(~F.col("included")).alias("excluded"),
        F.count_if(~F.col("confidence_missing") & (F.col("confidence") < config.minimum_confidence)).alias("low_confidence"),
        F.count_if("review_required").alias("review_required"),
        F.count_if("missing_total").alias("missing_total"),
        F.count_if(F.col("store_key") == T.UNKNOWN_STORE).alias("missing_store"),
        F.count_if(~F.col("schema_valid") | ~F.col("confidence_valid")).alias("invalid"),
        F.count_if("duplicate").alias("duplicates"),
    )


def reason_counts(decided_: DataFrame) -> DataFrame:
    return decided_.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("receipts"))


def spend_by_reason(decided_: DataFrame) -> DataFrame:
    return decided_.where("not included and total is not null").groupBy(F.col("primary_reason").alias("reason")).agg(F.sum("total").cast(V.MONEY).alias("spend"), F.count("*").alias("receipts"))


def unassigned(decided_: DataFrame) -> DataFrame:
    return decided_.where(F.col("included") & F.col("total").isNotNull() & (F.col("store_key") == T.UNKNOWN_STORE)).agg(F.coalesce(F.sum("total").cast(V.MONEY), F.lit(0).cast(V.MONEY)).alias("spend"), F.count("*").alias("receipts"))


def reconcile(decided_: DataFrame) -> DataFrame:
    """Sum over stores against the overall sum; two one-row tables side by side."""
    whole = decided_.where("included and total is not null").agg(F.coalesce(F.sum("total").cast(V.MONEY), F.lit(0).cast(V.MONEY)).alias("total_spend"))
    stores = spend_per_store(decided_).agg(F.coalesce(F.sum("spend").cast(V.MONEY), F.lit(0).cast(V.MONEY)).alias("store_spend"))
    gap = (F.col("total_spend") - F.col("store_spend")).cast(V.MONEY)
    return whole.crossJoin(stores).withColumn("difference", gap).withColumn("reconciled", F.col("difference") == 0)


def status(files: Column, loaded: Column, failures: Column, excluded: Column, reconciled: Column) -> Column:
    return F.when(files == 0, "empty").when((loaded == 0) & (failures > 0), "failed").when(~reconciled | (failures > 0) | (excluded > 0), "partial").otherwise("success")


def receipt_table(decided_: DataFrame) -> DataFrame:
    """The flat table for CSV output, reasons joined by semicolons."""
    flat = decided_.withColumn("reasons", F.array_join("reasons", ";")).withColumn("errors", F.array_join("errors", ";"))
    return flat.withColumnRenamed("total", "total_amount")
