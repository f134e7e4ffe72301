"""Evaluation of predictions against truth: alignment, field and item accuracy, calibration, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import Evaluation
from tallyforge.functions import text as T
from tallyforge.functions import values as V
from tallyforge.functions.arrow import sequence_ratio


def index(df: DataFrame, key: str = "receipt_id") -> DataFrame:
    """One row per id with its row count; an id seen twice loses its values (ambiguous)."""
    values = [c for c in df.columns if c != key]
    once = F.count("*") == 1
    return df.groupBy(key).agg(F.count("*").alias("n"), *(F.when(once, F.first(c)).alias(c) for c in values))


def align(pred: DataFrame, truth: DataFrame, key: str = "receipt_id") -> DataFrame:
    """Full outer alignment with each side's status: available, missing or duplicate."""
    state = lambda n: F.when(n.isNull(), "missing").when(n > 1, "duplicate").otherwise("available")
    p, t = index(pred, key), index(truth, key)
    p = p.select(key, F.col("n").alias("__p"), *(F.col(c).alias(f"pred_{c}") for c in p.columns if c not in (key, "n")))
    t = t.select(key, F.col("n").alias("__t"), *(F.col(c).alias(f"truth_{c}") for c in t.columns if c not in (key, "n")))
    out = p.join(t, key, "full_outer")
    return out.withColumns({"prediction_status": state(F.col("__p")), "truth_status": state(F.col("__t"))}).drop("__p", "__t")


def strings_match(pred: Column, truth: Column, config: Evaluation = Evaluation()) -> Column:
    """Null truth: not evaluable (null); missing prediction: false; else equal after normalising.

    Without strict strings a ratio of matching blocks that reaches the threshold is enough; only that
    mode leaves the JVM.
    """
    a, b = T.evaluation_text(pred), T.evaluation_text(truth)
    same = a == b if config.strict_strings else (a == b) | (sequence_ratio(a, b) >= config.string_threshold)
    return F.when(truth.isNull(), None).otherwise(F.coalesce(same, F.lit(False)))


def dates_match(pred: Column, truth: Column, order: str = "DMY") -> Column:
    a, b = V.date_in_order(pred, order), V.date_in_order(truth, order)
    return F.when(truth.isNull(), None).otherwise(F.coalesce(F.coalesce(a, pred) == F.coalesce(b, truth), F.lit(False)))


def amounts_match(pred: Column, truth: Column, tolerance: float = 0.01) -> Column:
    """Null truth: not evaluable; missing prediction: false; else within the tolerance after half-even rounding."""
    a, b = V.money_half_even(pred), V.money_half_even(truth)
    return F.when(b.isNull(), None).otherwise(F.coalesce(F.abs(a - b) <= F.lit(tolerance).cast("decimal(10,4)"), F.lit(False)))


def fields(aligned: DataFrame, config: Evaluation = Evaluation()) -> DataFrame:
    """Tri-state correctness of the three required fields; without available truth all are null."""
    known = F.col("truth_status") == "available"
    checks = {
        "store_correct": strings_match(F.col("pred_store_name"), F.col("truth_store_name"), config),
        "date_correct": dates_match(F.col("pred_date"), F.col("truth_date"), config.date_order),
        "total_correct": amounts_match(F.col("pred_total_amount"), F.col("truth_total_amount"), config.amount_tolerance),
    }
    out = aligned.withColumns({k: F.when(known, c) for k, c in checks.items()})
    evaluable = sum((F.col(k).isNotNull().cast("int") for k in checks), F.lit(0))
    right = sum((F.coalesce(F.col(k).cast("int"), F.lit(0)) for k in checks), F.lit(0))
    return out.withColumns({
        "required_fields_accuracy": F.when(evaluable > 0, F.round(right / evaluable, 6)),
        "required_fields_all_correct": F.when(evaluable == 3, right == 3),
    })


def accuracy(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Per field: correct and evaluable counts and their rate, from tri-state columns in one pass."""
    one = df.agg(*(x for name, c in columns.items() for x in (F.count_if(c).alias(f"{name}__c"), F.count(c).alias(f"{name}__e"))))
    rows = F.array(*(F.struct(F.lit(n).alias("field"), F.col(f"{n}__c").alias("correct"), F.col(f"{n}__e").alias("evaluable")) for n in columns))
    return one.select(F.inline(rows)).withColumn("accuracy", F.round(F.try_divide("correct", "evaluable"), 6))


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where a denominator is 0, all 1 where both sides are empty."""
    empty = (tp + fp + fn) == 0
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return {k: F.round(F.when(empty, 1.0).otherwise(c), 6) for k, c in (("precision", p), ("recall", r), ("f1", f))}


def item_counts(pred: DataFrame, truth: DataFrame, matched: DataFrame, key: str = "receipt_id") -> DataFrame:
    """tp, fp and fn of each receipt that has items on either side; one shuffle, sums combine on the map side."""
    one = lambda df, *which: df.select(key, *(F.lit(w).alias(n) for w, n in zip(which, "ptm")))
    out = one(pred, 1, 0, 0).unionAll(one(truth, 0, 1, 0)).unionAll(one(matched, 0, 0, 1)).groupBy(key).agg(*(F.sum(n).alias(n) for n in "ptm"))
    return out.select(key, F.col("m").alias("tp"), (F.col("p") - F.col("m")).alias("fp"), (F.col("t") - F.col("m")).alias("fn"))


def micro_macro(counts: DataFrame) -> DataFrame:
    """One row: pooled counts and their rates, and the means of the receipts' rates."""
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    per = counts.withColumns(rates(tp, fp, fn))
    pooled = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), *(F.round(F.avg(c), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    return pooled.withColumns({f"micro_{k}": c for k, c in rates(tp, fp, fn).items()})


def error_rates(df: DataFrame, truth: str, read: str) -> DataFrame:
    """Character and word distances of two compared texts, lengths of the true one, and their rates (a length of 1 at least)."""
    a, b = F.col(truth), F.col(read)
    out = df.withColumns({
        "char_distance": F.levenshtein(a, b).cast("bigint"), "reference_chars": F.length(a).cast("bigint"), "word_distance": T.word_distance(a, b).cast("bigint"), "reference_words": T.word_count(a).cast("bigint"),
    })
    rate = lambda edits, length: F.round(F.col(edits) / F.greatest(F.lit(1), F.col(length)), 6)
    return out.withColumns({"cer": rate("char_distance", "reference_chars"), "wer": rate("word_distance", "reference_words")})


def corpus_metric(df: DataFrame, distance: str, length: str, name: str) -> DataFrame:
    """Micro rate: summed distances over summed reference lengths (1 at least)."""
    out = df.agg(F.coalesce(F.sum(distance), F.lit(0)).alias("edits"), F.coalesce(F.sum(length), F.lit(0)).alias("reference"))
    return out.withColumn(name, F.round(F.col("edits") / F.greatest(F.lit(1), F.col("reference")), 6))


def calibration_sums(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Equal-width bins ``[low, high)``, the last one closed, with count, mean confidence and accuracy, not rounded; empty bins stay.

    Rows are summed by bin first, so the range join is of at most ``bins`` rows on either side.
    """
    spark = df.sparkSession
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"), (F.col("id") / bins).alias("low"), ((F.col("id") + 1) / bins).alias("high"))
    at = F.lit(None).cast("int")
    for i in reversed(range(bins)):  # comparisons with i / n, as the edges are made
        upper = F.col(confidence) <= 1.0 if i == bins - 1 else F.col(confidence) < (i + 1) / bins
        at = F.when((F.col(confidence) >= i / bins) & upper, i).otherwise(at)
    rows = df.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).withColumn("bin", at).where("bin is not null")
    sums = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("int")).alias("a"))
    out = edges.join(F.broadcast(sums), "bin", "left")
    return out.select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("receipts"), F.col("c").alias("mean_confidence"), F.col("a").alias("accuracy"))


def calibration(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """``calibration_sums`` as shown, rounded to six digits."""
    rounded = (F.round(c, 6).alias(c) for c in ("mean_confidence", "accuracy"))
    return calibration_sums(df, confidence, correct, bins).select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "receipts", *rounded)


def calibration_error(df: DataFrame, confidence: str = "confidence", correct: str = "correct", bins: int = 10) -> DataFrame:
    """Count-weighted mean gap between confidence and accuracy, rounded only at the end."""
    b = calibration_sums(df, confidence, correct, bins)
    gap = F.col("receipts") * F.abs(F.col("mean_confidence") - F.col("accuracy"))
    return b.agg(F.sum("receipts").alias("receipts"), F.round(F.try_divide(F.sum(gap), F.sum("receipts")), 4).alias("expected_calibration_error"))


def receipt_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per metric over receipts that have it: how many, mean and exact median."""
    one = df.agg(*(x for c in columns for x in (F.count(c).alias(f"{c}__n"), F.avg(c).alias(f"{c}__a"), F.median(c).alias(f"{c}__m"))))
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"{c}__n").alias("receipts"), F.col(f"{c}__a").alias("mean"), F.col(f"{c}__m").alias("median")) for c in columns))
    return one.select(F.inline(rows)).select("metric", "receipts", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def ids(df: DataFrame, key: str = "receipt_id") -> DataFrame:
    """The distinct ids of one side."""
    return df.select(key).distinct()


def missing(pred: DataFrame, truth: DataFrame, key: str = "receipt_id") -> DataFrame:
    """Ids of the truth without a prediction; with the sides changed, extra predictions."""
    return ids(truth, key).join(ids(pred, key), key, "left_anti")


def common(pred: DataFrame, truth: DataFrame, key: str = "receipt_id") -> DataFrame:
    """Ids on both sides."""
    return ids(pred, key).join(ids(truth, key), key, "left_semi")


def either(pred: DataFrame, truth: DataFrame, key: str = "receipt_id") -> DataFrame:
    """Ids on any side."""
    return pred.select(key).unionByName(truth.select(key)).distinct()


def gates(metrics: DataFrame, config: Evaluation = Evaluation()) -> DataFrame:
    """Status of six thresholds over a one-row table of metrics, and the overall one.

    Columns: corpus_cer, corpus_wer, store_accuracy, date_accuracy, total_accuracy, item_f1 (null: not evaluable).
    """
    specs = (("corpus_cer", "max", config.max_cer), ("corpus_wer", "max", config.max_wer), ("store_accuracy", "min", config.min_store), ("date_accuracy", "min", config.min_date), ("total_accuracy", "min", config.min_total), ("item_f1", "min", config.min_item_f1))

    def status(name: str, kind: str, limit: float | None) -> Column:
        if limit is None or not config.gates_enabled:
            return F.lit("not_configured")
        ok = F.col(name) <= limit if kind == "max" else F.col(name) >= limit
        return F.when(F.col(name).isNull(), "not_evaluable").when(ok, "passed").otherwise("failed")

    rows = [F.struct(F.lit(n).alias("gate"), F.col(n).cast("double").alias("value"), F.lit(limit).cast("double").alias("threshold"), status(n, k, limit).alias("status")) for n, k, limit in specs]
    states = F.array(*(status(n, k, limit) for n, k, limit in specs))
    overall = F.when(F.array_contains(states, "failed"), "failed").when(F.array_contains(states, "passed"), "passed").otherwise("not_evaluable")
    last = F.struct(F.lit("overall").alias("gate"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("threshold"), overall.alias("status"))
    return metrics.select(F.inline(F.array(*rows, last)))


def warnings(df: DataFrame, config: Evaluation = Evaluation(), cer: str = "cer", wer: str = "wer", f1: str = "item_f1") -> DataFrame:
    """Per-receipt warning and error codes of evaluated rows."""
    return df.withColumns({
        "warnings": V.codes((F.col(cer) > 0.20, "high_character_error_rate"), (F.col(wer) > 0.30, "high_word_error_rate"), (~F.col("store_correct"), "store_name_mismatch"), (~F.col("date_correct"), "date_mismatch"),
                            (~F.col("total_correct"), "total_amount_mismatch"), (F.col(f1) < 0.70, "item_extraction_f1_below_threshold")),
        "errors": V.codes((F.col("prediction_status") == "missing", "prediction_missing"), (F.col("prediction_status") == "duplicate", "duplicate_prediction_receipt_id"), (F.col("truth_status") == "duplicate", "duplicate_ground_truth_receipt_id")),
    })


def coverage(aligned: DataFrame) -> DataFrame:
    """One row of set sizes over an alignment."""
    p, t = F.col("prediction_status"), F.col("truth_status")
    return aligned.agg(
        F.count_if(p != "missing").alias("predictions"), F.count_if(t != "missing").alias("truths"), F.count("*").alias("all_ids"),
        F.count_if((p == "missing") & (t != "missing")).alias("missing_predictions"), F.count_if((t == "missing") & (p != "missing")).alias("extra_predictions"),
        F.count_if((p == "available") & (t == "available")).alias("matched"), F.count_if((p == "duplicate") | (t == "duplicate")).alias("ambiguous"),
    )
