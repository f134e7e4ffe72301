"""The end-to-end reports."""

import pytest
from pyspark.sql import functions as F

from tallyforge.plans import reports
from tallyforge.plans.stand_ins import RECEIPTS, view

RECEIPT = "receipt_id string, store_name string, date string, total_amount string, items array<struct<name:string,price:double>>"


def test_financial_report(spark, sf_dir, tmp_path):
    got = reports.financial_report(view(spark, sf_dir, RECEIPTS), str(tmp_path / "out"), failures=2)
    assert got["included"] + got["excluded"] == got["loaded"] and got["status"] == "partial" and got["reconciled"]
    read = lambda n: spark.read.option("header", True).csv(str(tmp_path / "out" / n))
    assert read("receipts").count() == got["loaded"] and read("audit").count() == got["excluded"]
    assert read("transactions_per_store").agg(F.sum(F.col("transactions").cast("int"))).first()[0] == got["transaction_count"]
    empty = reports.financial_report(view(spark, sf_dir, RECEIPTS).limit(0), str(tmp_path / "empty"))
    assert empty["status"] == "empty" and float(empty["total_spend"]) == 0 and empty["minimum_spend"] is None


def test_evaluation_report(spark):
    pred = spark.createDataFrame(
        [("1", "Shop", "2024-01-05", "10.00", [("tea", 10.0), ("bun", 1.0)], 0.95), ("2", "Other", None, "5", [], 0.4), ("3", "X", None, "1", None, 2.0)], RECEIPT + ", confidence double")
    truth = spark.createDataFrame(
        [("1", "shop", "05/01/2024", "10.001", [("Tea", 10.0), ("cake", 2.0)], "tea 10 total"), ("2", "Store", None, "5", [], None), ("4", "Y", None, None, None, "")], RECEIPT + ", full_text string")
    ocr = spark.createDataFrame([("1", "tea 1O total"), ("9", "none")], "receipt_id string, full_text string")
    rows = {r["receipt_id"]: r for r in reports.evaluate(pred, truth, ocr).collect()}
    assert set(rows) == {"1", "2", "3", "4"}
    assert (rows["1"]["tp"], rows["1"]["fp"], rows["1"]["fn"]) == (1, 1, 1) and rows["1"]["required_fields_all_correct"]
    assert rows["1"]["cer"] == pytest.approx(1 / 12, abs=1e-6) and rows["1"]["wer"] == pytest.approx(1 / 3, abs=1e-6)
    assert rows["1"]["warnings"] == ["high_word_error_rate", "item_extraction_f1_below_threshold"]
    assert rows["2"]["item_f1"] == 1.0 and rows["2"]["warnings"] == ["store_name_mismatch"]
    assert rows["4"]["errors"] == ["prediction_missing"] and rows["3"]["store_correct"] is None
    out = reports.evaluation_report(reports.evaluate(pred, truth, ocr))
    gates = {r["gate"]: r["status"] for r in out["gates"].collect()}
    assert gates["corpus_cer"] == "passed" and gates["item_f1"] == "failed" and gates["overall"] == "failed"
    assert out["calibration"].where("receipts > 0").count() == 1
    assert out["coverage"].first()["missing_predictions"] == 1
    bare = reports.evaluation_report(reports.evaluate(pred, truth))
    assert {r["gate"]: r["status"] for r in bare["gates"].collect()}["corpus_cer"] == "not_evaluable"
