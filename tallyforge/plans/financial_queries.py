"""Financial summary and duplicate-policy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import values as V
from tallyforge.operators import canonical, dedup, financial
from tallyforge.plans.registry import query
from tallyforge.plans.stand_ins import ITEMS, RECEIPTS, oracle, table, view
from tallyforge.sources import files

AMOUNT_SQL = "trim(replace(regexp_replace(trim({c}), '(?i)(₹|rs\\.?|inr)', '', 'g'), ',', ''))"
_T = AMOUNT_SQL.format(c="total_amount")
DECIDED = f"""
WITH receipts AS ({oracle(RECEIPTS)}),
n AS (SELECT *, {_T} AS t, try_cast(overall_confidence AS DOUBLE) AS conf, trim(regexp_replace(store_name, '\\s+', ' ', 'g')) AS shown,
  trim(regexp_replace(upper(store_name), '[^A-Z0-9]+', ' ', 'g')) AS key FROM receipts),
m AS (SELECT receipt_id, source_file, date, validation_status, total_amount AS raw, overall_confidence AS raw_conf,
  CASE WHEN shown <> '' THEN shown END AS store_name, CASE WHEN key <> '' THEN key ELSE '__UNKNOWN_STORE__' END AS store_key,
  CASE WHEN try_cast(t AS DECIMAL(38,10)) >= 0 AND NOT (t LIKE '(%)') THEN CAST(round(try_cast(t AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) END AS total,
  (overall_confidence IS NULL OR (conf IS NOT NULL AND conf BETWEEN 0 AND 1)) AS cv, conf,
  coalesce(lower(trim(review_required)) IN ('true','yes','y','1'), false) AS review,
  (date IS NULL OR (regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_strptime(date, '%Y-%m-%d') IS NOT NULL)) AS dv,
  count(*) OVER (PARTITION BY receipt_id) > 1 AS dup FROM n),
f AS (SELECT *, CASE WHEN cv THEN coalesce(conf, 0) ELSE 0 END AS c, raw IS NULL AS mt, raw IS NOT NULL AND total IS NULL AS it,
  list_sort(list_filter([CASE WHEN validation_status IS NULL THEN 'validation_status_missing' END, CASE WHEN validation_status <> 'passed' THEN 'validation_failed' END,
    CASE WHEN NOT dv THEN 'invalid_date' END, CASE WHEN raw IS NOT NULL AND total IS NULL THEN 'invalid_total' END, CASE WHEN NOT cv THEN 'invalid_confidence' END], lambda x: x IS NOT NULL)) AS errors FROM m),
g AS (SELECT *, CASE WHEN list_contains(errors, 'validation_failed') THEN 'validation_failed' WHEN list_contains(errors, 'validation_status_missing') THEN 'validation_status_missing' ELSE 'valid' END AS cls, len(errors) = 0 AS sv FROM f),
decided AS (SELECT *, list_filter([CASE WHEN dup THEN 'duplicate_receipt_id' END, CASE WHEN cls = 'validation_failed' THEN cls END, CASE WHEN cls = 'validation_status_missing' THEN cls END,
  CASE WHEN NOT sv AND cls = 'valid' THEN 'schema_invalid' END, CASE WHEN mt THEN 'missing_total' END, CASE WHEN it THEN 'invalid_total' END, CASE WHEN review THEN 'review_required' END,
  CASE WHEN NOT cv THEN 'invalid_confidence' END, CASE WHEN cv AND c < 0.70 THEN 'low_confidence' END], lambda x: x IS NOT NULL) AS reasons FROM g)
"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return financial.decided(view(spark, sf_dir, RECEIPTS))


def money(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@query(DECIDED + "SELECT receipt_id, source_file, store_key, CAST(total AS DOUBLE) AS total FROM decided WHERE len(reasons) = 0")
def trusted_receipts(spark, sf_dir):
    return money(decided(spark, sf_dir).where("included").select("receipt_id", "source_file", "store_key", "total"), "total")


@query(DECIDED + "SELECT source_file, array_to_string(reasons, ';') AS reasons FROM decided")
def exclusion_reasons(spark, sf_dir):
    return decided(spark, sf_dir).select("source_file", F.array_join("reasons", ";").alias("reasons"))


@query(DECIDED + "SELECT source_file, reasons[1] AS primary_reason FROM decided")
def primary_exclusion(spark, sf_dir):
    return decided(spark, sf_dir).select("source_file", "primary_reason")


@query(DECIDED + "SELECT source_file, array_to_string(errors, ';') AS errors, cls AS classification FROM decided")
def schema_validation_errors(spark, sf_dir):
    return financial.records(view(spark, sf_dir, RECEIPTS)).select("source_file", F.array_join("errors", ";").alias("errors"), "classification")


SPEND = ", s AS (SELECT store_key, arg_min(store_name, source_file) AS store_name, CAST(sum(total) AS DOUBLE) AS spend, count(*) AS transactions FROM decided WHERE len(reasons) = 0 AND total IS NOT NULL GROUP BY store_key) "


@query(DECIDED + SPEND + "SELECT store_key, store_name, spend FROM s")
def spend_per_store(spark, sf_dir):
    return money(financial.spend_per_store(decided(spark, sf_dir)), "spend").drop("transactions")


@query(DECIDED + SPEND + "SELECT store_key, store_name, transactions FROM s")
def transactions_per_store(spark, sf_dir):
    return financial.spend_per_store(decided(spark, sf_dir)).drop("spend")


@query(DECIDED + SPEND + "SELECT store_key, store_name, spend, transactions, row_number() OVER (ORDER BY spend DESC, lower(store_name) NULLS FIRST, store_key) AS rank FROM s")
def spend_per_store_ranked(spark, sf_dir):
    return money(financial.ranked(financial.spend_per_store(decided(spark, sf_dir))), "spend").withColumn("rank", F.col("rank").cast("bigint"))


@query(DECIDED + """SELECT CAST(coalesce(sum(total), 0) AS DOUBLE) AS total_spend, count(*) AS transaction_count, round(CAST(coalesce(sum(total) / count(*), 0) AS DOUBLE), 2) AS average_spend,
  round(CAST(coalesce(median(total), 0) AS DOUBLE), 2) AS median_spend, CAST(min(total) AS DOUBLE) AS minimum_spend, CAST(max(total) AS DOUBLE) AS maximum_spend FROM decided WHERE len(reasons) = 0 AND total IS NOT NULL""")
def financial_summary_totals(spark, sf_dir):
    return money(financial.totals(decided(spark, sf_dir)), "total_spend", "average_spend", "median_spend", "minimum_spend", "maximum_spend")


@query(DECIDED + """SELECT count(*) AS loaded, count(*) FILTER (len(reasons) = 0) AS included, count(*) FILTER (len(reasons) > 0) AS excluded, count(*) FILTER (raw_conf IS NOT NULL AND c < 0.70) AS low_confidence,
  count(*) FILTER (review) AS review_required, count(*) FILTER (mt) AS missing_total, count(*) FILTER (store_key = '__UNKNOWN_STORE__') AS missing_store, count(*) FILTER (NOT sv OR NOT cv) AS invalid, count(*) FILTER (dup) AS duplicates FROM decided""")
def audit_counters(spark, sf_dir):
    return financial.counters(decided(spark, sf_dir))


@query(DECIDED + "SELECT reason, count(*) AS receipts FROM (SELECT unnest(reasons) AS reason FROM decided) GROUP BY reason")
def exclusion_reason_counts(spark, sf_dir):
    return financial.reason_counts(decided(spark, sf_dir))


@query(DECIDED + "SELECT reasons[1] AS reason, CAST(sum(total) AS DOUBLE) AS spend, count(*) AS receipts FROM decided WHERE len(reasons) > 0 AND total IS NOT NULL GROUP BY 1")
def exclusion_spend_by_reason(spark, sf_dir):
    return money(financial.spend_by_reason(decided(spark, sf_dir)), "spend")


@query(DECIDED + "SELECT CAST(coalesce(sum(total), 0) AS DOUBLE) AS spend, count(*) AS receipts FROM decided WHERE len(reasons) = 0 AND total IS NOT NULL AND store_key = '__UNKNOWN_STORE__'")
def unassigned_spend(spark, sf_dir):
    return money(financial.unassigned(decided(spark, sf_dir)), "spend")


@query(DECIDED + SPEND + """SELECT (SELECT CAST(coalesce(sum(total), 0) AS DOUBLE) FROM decided WHERE len(reasons) = 0 AND total IS NOT NULL) AS total_spend, round(coalesce(sum(spend), 0), 2) AS store_spend, 0.0 AS difference, true AS reconciled FROM s""")
def reconcile_spend(spark, sf_dir):
    return money(financial.reconcile(decided(spark, sf_dir)), "total_spend", "store_spend", "difference")


@query(f"SELECT receipt_id, min(source_file) AS source_file FROM ({oracle(RECEIPTS)}) GROUP BY receipt_id")
def dedup_keep_first(spark, sf_dir):
    return dedup.keep_first(view(spark, sf_dir, RECEIPTS).select("receipt_id", "source_file"), "receipt_id", "source_file")


@query(f"SELECT receipt_id, min(source_file) AS source_file FROM ({oracle(RECEIPTS)}) GROUP BY receipt_id HAVING count(*) = 1")
def dedup_drop_ambiguous(spark, sf_dir):
    return dedup.drop_ambiguous(view(spark, sf_dir, RECEIPTS).select("receipt_id", "source_file"), "receipt_id")


@query(f"SELECT receipt_id, source_file FROM (SELECT *, count(*) OVER (PARTITION BY receipt_id) AS n FROM ({oracle(RECEIPTS)})) WHERE n > 1")
def duplicate_receipts(spark, sf_dir):
    return dedup.flag_repeats(view(spark, sf_dir, RECEIPTS).select("receipt_id", "source_file"), "receipt_id").where("duplicate").drop("duplicate")


@query("SELECT doc_id, sha256(text) AS sha256, min(doc_id) OVER (PARTITION BY text) AS first, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents")
def duplicate_content(spark, sf_dir):
    return dedup.first_with_hash(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id").select("doc_id", "sha256", "first", "is_duplicate")


ROLLUP = f"WITH i AS ({oracle(ITEMS)}) SELECT receipt_id, CAST(sum(price) AS DOUBLE) AS item_sum, count(*) AS items, CAST(min(price) AS DOUBLE) AS least, CAST(max(price) AS DOUBLE) AS greatest FROM i GROUP BY receipt_id"


@query(ROLLUP)
def items_rollup(spark, sf_dir):
    """In-array aggregates over the item array of each receipt."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    packed = rows.groupBy(F.col("l_orderkey").alias("receipt_id")).agg(F.collect_list(F.col("l_extendedprice").cast("decimal(18,2)")).alias("prices"))
    made = packed.select("receipt_id", *(c.alias(n) for n, c in canonical.price_rollup(F.col("prices")).items()))
    return money(made, "item_sum", "least", "greatest")


#: Canonical documents as JSON texts; what is null is absent.
DOCUMENTS = f"SELECT source_file, receipt_id, store_name, date, total_amount, CAST(overall_confidence AS STRING) AS overall_confidence, review_required, validation_status FROM ({RECEIPTS}) r"


@query(f"""SELECT receipt_id, source_file, store_name, date, total_amount, overall_confidence, review_required, validation_status,
  array_to_string(list_filter([CASE WHEN store_name IS NULL THEN 'missing_required_field:store_name' END, CASE WHEN date IS NULL THEN 'missing_required_field:date' END, CASE WHEN total_amount IS NULL THEN 'missing_required_field:total_amount' END,
    CASE WHEN overall_confidence IS NULL THEN 'missing_required_field:overall_confidence' END, CASE WHEN review_required IS NULL THEN 'missing_required_field:review_required' END], lambda x: x IS NOT NULL), ';') AS malformed
FROM ({oracle(DOCUMENTS)})""")
def financial_input_flatten(spark, sf_dir):
    """Nested documents, written as JSON and read by the library, as flat rows with codes for what is absent."""
    doc = F.struct(
        "store_name", "date", F.array().cast("array<string>").alias("items"), "total_amount", "overall_confidence", F.lit("high").alias("reliability"), "review_required", F.struct("receipt_id").alias("metadata"),
        F.when(F.col("validation_status").isNotNull(), F.struct(F.col("validation_status").alias("status"))).alias("_validation"),
    )
    docs = files.keyed(view(spark, sf_dir, DOCUMENTS).select("source_file", F.to_json(doc).alias("raw")))
    return files.financial_input(docs).withColumn("malformed", F.array_join("malformed", ";"))


@query(f"""WITH i AS ({oracle(ITEMS)}), j AS (SELECT receipt_id, pos, CASE WHEN pos % 5 = 4 THEN '  ' ELSE ' ' || name END AS name, CASE WHEN pos % 3 = 2 THEN -1.0 ELSE CAST(price AS DOUBLE) END AS price, pos * 0.3 AS confidence FROM i)
SELECT receipt_id, string_agg(trim(name) || '=' || coalesce(CAST(CAST(CASE WHEN price >= 0 THEN price END AS DECIMAL(18,2)) AS VARCHAR), 'null'), ';' ORDER BY pos) FILTER (trim(name) <> '') AS items,
  coalesce(string_agg(CASE WHEN trim(name) = '' THEN 'items[' || pos || ']_name_missing' || CASE WHEN confidence > 1 THEN ';' ELSE '' END ELSE '' END || CASE WHEN confidence > 1 THEN 'items[' || pos || ']_confidence_invalid' ELSE '' END, ';' ORDER BY pos)
    FILTER (trim(name) = '' OR confidence > 1), '') AS warnings FROM j GROUP BY receipt_id""")
def normalize_items(spark, sf_dir):
    rows = view(spark, sf_dir, ITEMS).select("receipt_id", F.struct("pos", F.when(F.col("pos") % 5 == 4, "  ").otherwise(F.concat(F.lit(" "), "name")).alias("name"), F.when(F.col("pos") % 3 == 2, -1.0).otherwise(F.col("price").cast("double")).alias("price"), (F.col("pos") * 0.3).alias("confidence")).alias("x"))
    packed = rows.groupBy("receipt_id").agg(F.array_sort(F.collect_list("x")).alias("items"))
    text = F.transform(canonical.normal_items(F.col("items")), lambda x: F.concat(x["name"], F.lit("="), F.coalesce(x["price"].cast("decimal(18,2)").cast("string"), F.lit("null"))))
    return packed.select("receipt_id", F.array_join(text, ";").alias("items"), F.array_join(canonical.item_warnings(F.col("items")), ";").alias("warnings"))


@query(f"SELECT source_file, CASE WHEN try_cast({_T} AS DECIMAL(38,10)) >= 0 AND NOT ({_T} LIKE '(%)') THEN CAST(CAST(round(try_cast({_T} AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS DOUBLE) END AS amount FROM ({oracle(RECEIPTS)})")
def amount_normalize(spark, sf_dir):
    return view(spark, sf_dir, RECEIPTS).select("source_file", V.money_half_up(F.col("total_amount")).cast("double").alias("amount"))


@query("SELECT lower(l_returnflag) AS flag, l_linenumber, CAST(sum(round_even(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(0.125 AS DECIMAL(4,3)), 2)) AS DOUBLE) AS total FROM lineitem GROUP BY ALL")
def amount_half_even(spark, sf_dir):
    x = (F.col("l_extendedprice").cast("decimal(18,2)") * F.lit("0.125").cast("decimal(4,3)")).cast("string")
    return table(spark, sf_dir, "lineitem").groupBy(F.lower("l_returnflag").alias("flag"), "l_linenumber").agg(F.sum(V.money_half_even(x)).cast("double").alias("total"))


@query(f"""WITH r AS ({oracle(RECEIPTS)}), v AS (SELECT *, try_cast(total_amount AS DOUBLE) AS t, try_cast(overall_confidence AS DOUBLE) AS c, length(source_file) AS n FROM r)
SELECT source_file, array_to_string(list_filter([CASE WHEN date IS NOT NULL AND (NOT regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') OR try_strptime(date, '%Y-%m-%d') IS NULL) THEN 'date_invalid' END, CASE WHEN review_required = 'yes' THEN 'item_price_invalid' END,
  CASE WHEN review_required = 'No' THEN 'items_missing' END, CASE WHEN c IS NULL OR NOT c BETWEEN 0 AND 1 THEN 'overall_confidence_invalid' END, CASE WHEN validation_status IS NULL THEN 'receipt_id_missing' END,
  CASE WHEN store_name IS NOT NULL AND validation_status = 'failed' THEN 'store_name_empty' END, CASE WHEN t > 100000 THEN 'total_amount_invalid' END], lambda x: x IS NOT NULL), ';') AS errors FROM v""")
def canonical_validation(spark, sf_dir):
    """Error codes of canonical documents with every kind of fault."""
    rows = view(spark, sf_dir, RECEIPTS)
    total = F.col("total_amount").try_cast("double")
    price = F.when(F.col("review_required") == "yes", -1.0).otherwise(1.0)
    items = F.when(F.coalesce(F.col("review_required") != "No", F.lit(True)), F.array(F.struct(price.alias("price"))))
    store = F.when(F.col("store_name").isNotNull() & (F.col("validation_status") == "failed"), "  ").otherwise(F.col("store_name"))
    rid = F.when(F.col("validation_status").isNotNull(), F.col("receipt_id"))
    errors = canonical.validation_errors(store, F.col("date"), F.when(total > 100000, -total).otherwise(total), F.col("overall_confidence").try_cast("double"), items, rid)
    return rows.select("source_file", F.array_join(errors, ";").alias("errors"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'empty' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 > 0 THEN 'failed' WHEN o_orderkey % 7 = 0 OR o_orderkey % 2 > 0 OR o_orderkey % 5 > 0 THEN 'partial' ELSE 'success' END AS status FROM orders""")
def summary_status(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", financial.status(k % 4, k % 3, k % 2, k % 5, k % 7 != 0).alias("status"))
