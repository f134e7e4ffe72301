"""Every reference query against its DuckDB oracle, and the plans that matter."""

import math

import pytest

from tallyforge.plans.catalog import ORACLES, QUERIES


def norm(v):
    if v is None or isinstance(v, (str, bool)):
        return str(v)
    if isinstance(v, int):
        return f"{v:.6g}"
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(x) else f"{x:.6g}" if x else "0"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_stay_in_the_jvm(spark, sf_dir):
    python = {"nfkc_normalize", "redact_nested", "item_match_counts", "item_micro_macro_f1", "item_metrics_per_receipt", "item_assignment_optimal", "item_assignment_greedy", "data_validation_stats"}
    for name, q in QUERIES.items():
        if name not in python:
            text = plan(q(spark, sf_dir))
            assert "Python" not in text and "InPandas" not in text, name
            assert "CartesianProduct" not in text, name


def test_scan_pushes_filters_and_prunes(spark, sf_dir):
    df = QUERIES["scan_filter_sorted"](spark, sf_dir)
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "In(source, [src1,src3,src5])" in text and "GreaterThanOrEqual(n_chars,200)" in text
    assert "text:string" not in text


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["store_key", "store_name", "spend"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_metamorphic(spark, sf_dir):
    from tallyforge.plans.financial_queries import decided

    d = decided(spark, sf_dir).cache()
    counts = QUERIES["audit_counters"](spark, sf_dir).first()
    assert counts["included"] + counts["excluded"] == counts["loaded"] == d.count()
    spend = QUERIES["spend_per_store"](spark, sf_dir).groupBy().sum("spend").first()[0]
    assert spend == pytest.approx(QUERIES["financial_summary_totals"](spark, sf_dir).first()["total_spend"])
    assert QUERIES["reconcile_spend"](spark, sf_dir).first()["reconciled"]


def test_canonical_documents_keep_small_rows(spark, sf_dir):
    text = plan(QUERIES["canonical_documents"](spark, sf_dir))
    kept = [x for x in text.splitlines() if "min_by(" in x]
    assert kept and not any(w in x for x in kept for w in ("candidate", "regions", "fields"))
    assert len(text) < 300_000
