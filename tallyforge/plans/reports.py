"""The two end-to-end reports: trusted spend from raw documents, and quality of predictions against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.config import Evaluation, Financial
from tallyforge.functions import text as T
from tallyforge.functions import values as V
from tallyforge.operators import evaluation, financial, matching
from tallyforge.sources import files


def financial_report(records: DataFrame, folder: str, failures: int = 0, config: Financial = Financial()) -> dict:
    """Writes receipt, audit, spend and transaction tables and a one-row summary below ``folder``; returns the summary.

    ``records`` is the input of ``financial.records``; ``failures`` counts documents that did not load.
    The decided records are written once and read by every output.
    """
    spark = records.sparkSession
    table = f"{folder}/decided"
    financial.decided(records, config).write.mode("overwrite").parquet(table)
    decided = spark.read.parquet(table)
    flat = financial.receipt_table(decided)
    files.write_csv(flat, f"{folder}/receipts")
    files.write_csv(flat.where(~F.col("included")), f"{folder}/audit")
    spend = financial.spend_per_store(decided)
    files.write_csv(financial.ranked(spend).drop("transactions"), f"{folder}/spend_per_store")
    files.write_csv(spend.select("store_key", "store_name", "transactions"), f"{folder}/transactions_per_store")
    files.write_csv(financial.reason_counts(decided), f"{folder}/exclusion_reasons", single=True)
    files.write_csv(financial.spend_by_reason(decided), f"{folder}/exclusion_spend", single=True)
    one = financial.totals(decided).crossJoin(financial.counters(decided, config)).crossJoin(financial.reconcile(decided).drop("total_spend"))
    one = one.withColumn("load_failures", F.lit(failures))
    one = one.withColumn("status", financial.status(F.col("loaded") + failures, F.col("loaded"), F.lit(failures), F.col("excluded"), F.col("reconciled")))
    files.write_json(one, f"{folder}/summary")
    return one.first().asDict()


def evaluate(pred: DataFrame, truth: DataFrame, ocr: DataFrame | None = None, config: Evaluation = Evaluation()) -> DataFrame:
    """One row per receipt of either side: statuses, field verdicts, item counts and rates, text error rates, warnings.

    ``pred`` and ``truth``: receipt_id, store_name, date, total_amount (text), items (array of name and
    price); ``pred`` also confidence, ``truth`` also full_text (null: not evaluable). ``ocr``: receipt_id
    and full_text, one row per id or none. Without available truth every metric is null.
    """
    fields = ["receipt_id", "store_name", "date", "total_amount"]
    out = evaluation.fields(evaluation.align(pred.select(*fields, "confidence"), truth.select(*fields)), config)
    once = evaluation.index
    p, t = once(pred.select("receipt_id", "items")), once(truth.select("receipt_id", "items", "full_text"))
    both = p.where("n = 1").select("receipt_id").join(t.where("n = 1 and items is not null").select("receipt_id"), "receipt_id", "left_semi")
    rows = lambda df: df.join(both, "receipt_id", "left_semi").select("receipt_id", F.posexplode("items").alias("pos", "x")).select("receipt_id", "pos", "x.name", "x.price")
    pi, ti = rows(p), rows(t)
    counts = evaluation.item_counts(pi, ti, matching.matches(matching.candidate_pairs(pi, ti, config=config)))
    counts = both.join(counts, "receipt_id", "left").na.fill(0, ["tp", "fp", "fn"])
    rates = evaluation.rates(F.col("tp"), F.col("fp"), F.col("fn"))
    out = out.join(counts.withColumns({f"item_{k}": c for k, c in rates.items()}), "receipt_id", "left")
    if ocr is None:
        return evaluation.warnings(out.withColumns({"cer": F.lit(None).cast("double"), "wer": F.lit(None).cast("double")}), config)
    read = once(ocr.select("receipt_id", "full_text")).select("receipt_id", F.col("full_text").alias("__h"))
    want = t.select("receipt_id", F.col("full_text").alias("__r"))
    texts = want.join(read, "receipt_id").where("__r is not null and __h is not null")
    texts = texts.select("receipt_id", T.evaluation_text(F.col("__r")).alias("__r"), T.evaluation_text(F.col("__h")).alias("__h"))
    out = out.join(evaluation.error_rates(texts, "__r", "__h").drop("__r", "__h"), "receipt_id", "left")
    return evaluation.warnings(out, config)


def evaluation_report(evaluated: DataFrame, config: Evaluation = Evaluation()) -> dict[str, DataFrame]:
    """Aggregates of ``evaluate``: coverage, field accuracy, items, texts, calibration and gates. Write it first: each reads it."""
    names = {"store": "store_correct", "date": "date_correct", "total": "total_correct", "all": "required_fields_all_correct"}
    accuracy = evaluation.accuracy(evaluated, names)
    items = evaluation.micro_macro(evaluated.where("tp is not null").select("tp", "fp", "fn"))
    wide = accuracy.agg(*(F.max(F.when(F.col("field") == f, F.col("accuracy"))).alias(f"{f}_accuracy") for f in ("store", "date", "total")))
    metrics = wide.crossJoin(items.select(F.col("micro_f1").alias("item_f1")))
    out = {"coverage": evaluation.coverage(evaluated), "field_accuracy": accuracy, "items": items}
    if "char_distance" in evaluated.columns:
        out["cer"] = evaluation.corpus_metric(evaluated, "char_distance", "reference_chars", "corpus_cer")
        out["wer"] = evaluation.corpus_metric(evaluated, "word_distance", "reference_words", "corpus_wer")
        metrics = metrics.crossJoin(out["cer"].select("corpus_cer")).crossJoin(out["wer"].select("corpus_wer"))
    else:
        metrics = metrics.withColumns({"corpus_cer": F.lit(None).cast("double"), "corpus_wer": F.lit(None).cast("double")})
    conf = V.safe_float(F.col("pred_confidence"))
    ranged = evaluated.withColumn("__conf", F.when(conf.between(0, 1), conf))
    out["calibration"] = evaluation.calibration(ranged, "__conf", "required_fields_all_correct", config.bins)
    out["calibration_error"] = evaluation.calibration_error(ranged, "__conf", "required_fields_all_correct", config.bins)
    out["gates"] = evaluation.gates(metrics, config)
    return out
