"""Field extraction queries over printed receipts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import extraction, scoring
from tallyforge.plans.registry import ORACLES, query
from tallyforge.plans.stand_ins import FRAMES, ITEM_LINES, ITEMS, LINES, oracle, table, view

ADDRESS = "(regexp_matches({c}, '\\b\\d{{5,}}\\b') OR regexp_matches({c}, '(?i)\\b\\d+\\s+[A-Z][A-Z0-9\\- ]{{2,}}\\b') OR regexp_matches({c}, '(?i)\\b(?:ST|STREET|ROAD|RD|AVE|AVENUE|DR|DRIVE|BLVD|LN|LANE|CT|COURT|CIR|HIGHWAY|HWY)\\b'))"
META = "(regexp_matches({c}, '(?i)ACCOUNT|REF|NETWORK|TERMINAL|TC\\s*#|APPR|APPROVAL|ITEMS\\s+SOLD|STORE\\s+HOURS|\\b[A-Z]{{2,}}\\s*#\\s*\\d+\\b|@') OR regexp_matches({c}, '\\b\\d{{4}}(?:\\s+\\d{{4}}){{2,}}\\b'))"
DMY, YMD = "\\b(\\d{1,2})[\\/\\-.](\\d{1,2})[\\/\\-.](\\d{2,4})\\b", "\\b(\\d{4})[\\/\\-.](\\d{1,2})[\\/\\-.](\\d{1,2})\\b"
_YEAR = "CASE WHEN length(regexp_extract({c}, '" + DMY + "', 3)) = 2 THEN '20' ELSE '' END || regexp_extract({c}, '" + DMY + "', 3)"
DATE_OF = (
    "coalesce(strftime(try_strptime(regexp_extract({c}, '" + DMY + "', 1) || '/' || regexp_extract({c}, '" + DMY + "', 2) || '/' || " + _YEAR + ", '%d/%m/%Y'), '%Y-%m-%d'), "
    "strftime(try_strptime(regexp_extract({c}, '" + YMD + "', 0), '%Y-%m-%d'), '%Y-%m-%d'))"
)
#: Lines with their place among the receipt's non-blank lines.
NUMBERED = f"l AS (SELECT receipt_id, CAST(row_number() OVER (PARTITION BY receipt_id ORDER BY pos) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY receipt_id) AS n, line FROM ({oracle(LINES)})), r AS (SELECT DISTINCT receipt_id FROM l)"
PRICE = "\\d{1,3}(?:,\\d{3})+(?:\\.\\d{1,2})?|\\d+(?:\\.\\d{1,2})?"
MARK = "(?:₹\\s*|Rs\\.?\\s*|INR\\s*)?"


def fmt(template: str, c: str) -> str:
    return template.replace("{c}", c).replace("{{", "{").replace("}}", "}")


def receipts(spark, sf_dir):
    """One row per receipt with its ordered lines."""
    items = view(spark, sf_dir, ITEM_LINES).groupBy("receipt_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"))
    none = F.array().cast("array<string>")
    rows = view(spark, sf_dir, FRAMES).join(items, "receipt_id", "left")
    return rows.select("receipt_id", F.concat("above", F.coalesce(F.transform("ls", lambda x: x["line"]), none), "below").alias("lines"))


def shown(df, name: str):
    """Value, confidence, method and place of a candidate column."""
    c = F.col(name)
    return df.select("receipt_id", c["value"].alias("value"), c["confidence"].alias("confidence"), c["extraction_method"].alias("method"), c["region_index"].alias("region_index"))


@query(f"""WITH {NUMBERED}, k AS (SELECT *, trim(regexp_replace(regexp_extract(line, '(?i)\\b(?:STORE|SHOP|VENDOR|MERCHANT|SELLER|STORE\\s+NAME|MERCHANT\\s+NAME)\\s*[:\\-]\\s*(.+)$', 1), '^[\\s:,\\-]+|[\\s:,\\-]+$', '', 'g')) AS named FROM l WHERE i < 8),
c AS (SELECT receipt_id, i, 0 AS pass, named AS value, 0.97 AS confidence, 'vendor_label' AS method FROM k WHERE named <> '' AND NOT {fmt(ADDRESS, 'named')}
UNION ALL SELECT receipt_id, i, 1, trim(regexp_replace(line, '^[\\s:,\\-]+|[\\s:,\\-]+$', '', 'g')), CASE WHEN i = 0 THEN 0.82 ELSE 0.70 END, 'top_line_heuristic' FROM k
  WHERE NOT (named <> '' AND NOT {fmt(ADDRESS, 'named')}) AND NOT regexp_matches(upper(line), 'DATE|TIME|RECEIPT|INVOICE|GST|TAX|TOTAL|PHONE|TEL|ADDRESS|BILL|SAVE MONEY') AND {fmt(DATE_OF, 'line')} IS NULL AND NOT {fmt(ADDRESS, 'line')} AND NOT {fmt(META, 'line')}
  AND length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 2 AND length(regexp_replace(line, '[^0-9]', '', 'g')) <= length(regexp_replace(line, '[^A-Za-z]', '', 'g'))),
b AS (SELECT receipt_id, arg_min({{'value': value, 'confidence': confidence, 'method': method, 'i': i}}, pass * 1000 + i) AS x FROM c GROUP BY 1)
SELECT r.receipt_id, x.value AS value, CAST(x.confidence AS DOUBLE) AS confidence, x.method AS method, x.i AS region_index FROM r LEFT JOIN b ON r.receipt_id = b.receipt_id""")
def extract_vendor(spark, sf_dir):
    return shown(receipts(spark, sf_dir).withColumn("v", extraction.vendor(F.col("lines"))), "v")


_LABEL = "regexp_extract(line, '(?i)\\b(?:DATE|TXN\\s+DATE|TRANSACTION\\s+DATE|BILL\\s+DATE|PURCHASE\\s+DATE)\\s*[:\\-]?\\s*(.+)$', 1)"


@query(f"""WITH {NUMBERED}, c AS (SELECT receipt_id, i, {fmt(DATE_OF, _LABEL)} AS labelled, {fmt(DATE_OF, 'line')} AS plain, {fmt(META, 'line')} AS meta FROM l),
k AS (SELECT receipt_id, i, coalesce(labelled, plain) AS value, CASE WHEN labelled IS NOT NULL THEN 0.99 WHEN meta THEN 0.88 ELSE 0.92 END AS confidence, CASE WHEN labelled IS NOT NULL THEN 'date_label_regex' ELSE 'date_regex' END AS method FROM c WHERE coalesce(labelled, plain) IS NOT NULL),
b AS (SELECT receipt_id, arg_min({{'value': value, 'confidence': confidence, 'method': method, 'i': i}}, (1 - confidence) * 100000 + i) AS x FROM k GROUP BY 1)
SELECT r.receipt_id, x.value AS value, CAST(x.confidence AS DOUBLE) AS confidence, x.method AS method, x.i AS region_index FROM r LEFT JOIN b ON r.receipt_id = b.receipt_id""")
def extract_date(spark, sf_dir):
    return shown(receipts(spark, sf_dir).withColumn("v", extraction.date(F.col("lines"))), "v")


TOTAL = f"""WITH {NUMBERED}, o AS (SELECT o_orderkey AS receipt_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS t FROM orders), m AS (SELECT receipt_id, max(n) AS n FROM l GROUP BY 1),
t AS (SELECT o.receipt_id, CASE WHEN o.receipt_id % 6 >= 4 THEN 7.25 ELSE t END AS value, CAST(CASE WHEN o.receipt_id % 6 IN (0, 3) THEN 0.98 WHEN o.receipt_id % 6 IN (1, 2) THEN 0.94 ELSE 0.60 END AS DOUBLE) AS confidence,
  CASE WHEN o.receipt_id % 6 IN (0, 2, 3) THEN 'total_keyword_amount' WHEN o.receipt_id % 6 = 1 THEN 'total_keyword_next_line' ELSE 'last_lines_amount_fallback' END AS method,
  CAST(CASE WHEN o.receipt_id % 6 IN (0, 1, 3) THEN n - 2 WHEN o.receipt_id % 6 = 2 THEN n - 1 ELSE n - 3 END AS INTEGER) AS region_index FROM o JOIN m ON o.receipt_id = m.receipt_id) """


@query(TOTAL + "SELECT * FROM t")
def extract_total(spark, sf_dir):
    return shown(receipts(spark, sf_dir).withColumn("v", extraction.total(F.col("lines"))), "v")


@query(TOTAL + "SELECT receipt_id, value FROM t WHERE method = 'total_keyword_next_line'")
def total_next_line(spark, sf_dir):
    out = extract_total(spark, sf_dir)
    return out.where("method = 'total_keyword_next_line'").select("receipt_id", "value")


@query(TOTAL + "SELECT receipt_id, value, region_index FROM t WHERE method = 'last_lines_amount_fallback'")
def total_fallback_tail(spark, sf_dir):
    return extract_total(spark, sf_dir).where("method = 'last_lines_amount_fallback'").select("receipt_id", "value", "region_index")


_LETTERS, _DIGITS = "length(regexp_replace(name, '[^A-Za-z]', '', 'g'))", "length(regexp_replace(name, '[^0-9]', '', 'g'))"


@query(TOTAL.rstrip() + f""", q AS (SELECT l.*, t.value AS total, regexp_extract(line, '(?i)^\\s*(.+?)\\s+(\\d+(?:\\.\\d+)?)\\s*[x*×]\\s*{MARK}({PRICE})\\s*$', ['name', 'qty', 'price']) AS a, regexp_extract(line, '(?i)^\\s*(.*?)\\s+{MARK}({PRICE})\\s*$', ['name', 'price']) AS b,
  regexp_extract(line, '(?i)^\\s*{MARK}({PRICE})\\s+(.+?)\\s*$', ['price', 'name']) AS c FROM l JOIN t ON l.receipt_id = t.receipt_id
  WHERE {fmt(DATE_OF, 'line')} IS NULL AND NOT {fmt(ADDRESS, 'line')} AND NOT {fmt(META, 'line')} AND NOT regexp_matches(upper(line), 'SUBTOTAL|TAX|VAT|GST|DISCOUNT|CHANGE|PAYMENT|INVOICE') AND NOT regexp_full_match(line, '[\\d.,]+')),
k AS (SELECT receipt_id, i, CASE WHEN a.price <> '' THEN a.name WHEN b.price <> '' THEN b.name ELSE c.name END AS name, CAST(nullif(CASE WHEN a.price <> '' THEN a.price WHEN b.price <> '' THEN b.price ELSE c.price END, '') AS DOUBLE) AS price,
  CASE WHEN a.price <> '' THEN 'quantity_price_regex' WHEN b.price <> '' THEN 'name_price_regex' ELSE 'price_name_regex' END AS method, total FROM q),
v AS (SELECT receipt_id, i, name, price, method, CAST(CASE method WHEN 'quantity_price_regex' THEN 0.92 WHEN 'price_name_regex' THEN 0.78 ELSE CASE WHEN abs(price - total) < 1e-9 THEN 0.55 ELSE 0.84 END END AS DOUBLE) AS confidence FROM k
  WHERE price BETWEEN 0 AND 1000000 AND length(name) BETWEEN 2 AND 80 AND {_LETTERS} >= 2 AND {_DIGITS} <= greatest(3, floor({_LETTERS} * 0.35)) AND NOT {fmt(ADDRESS, 'name')} AND NOT {fmt(META, 'name')} AND NOT regexp_matches(name, '[#@]')
  AND NOT regexp_matches(upper(name), 'TOTAL|TAX|VAT|GST|DISCOUNT|CHANGE|PAYMENT|CARD|DEBIT|CREDIT|REF|ACCOUNT|NETWORK|TERMINAL|APPR|CODE|STORE HOURS|ITEMS SOLD|SAVE MONEY|THANK YOU|CASHIER|MANAGER|EFT|TEND|BALANCE|PAY FROM|PURCHASE'))
SELECT receipt_id, i AS region_index, name, price, method, confidence FROM (SELECT *, row_number() OVER (PARTITION BY receipt_id, lower(name), round(price, 2) ORDER BY i) AS k FROM v) WHERE k = 1""")
def extract_items(spark, sf_dir):
    rows = receipts(spark, sf_dir).withColumn("t", extraction.total(F.col("lines")))
    rows = rows.select("receipt_id", F.explode(extraction.items(F.col("lines"), F.col("t.value"))).alias("x"))
    return rows.select("receipt_id", "x.region_index", "x.name", "x.price", F.col("x.extraction_method").alias("method"), "x.confidence")


@query(f"SELECT receipt_id, min(pos) AS pos, lower(name) AS name, CAST(price AS DOUBLE) AS price FROM (SELECT receipt_id, pos, name, CAST(CAST(price AS BIGINT) // 20000 AS DECIMAL(18,2)) AS price FROM ({oracle(ITEMS)})) GROUP BY receipt_id, lower(name), price")
def item_dedup(spark, sf_dir):
    rows = view(spark, sf_dir, ITEMS).select("receipt_id", F.struct("pos", "name", F.expr("CAST(round(price) AS BIGINT) DIV 20000").cast("double").alias("price")).alias("x"))
    packed = rows.groupBy("receipt_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return packed.select("receipt_id", F.inline(extraction.unique_items(F.col("xs")))).withColumn("name", F.lower("name"))


@query("""SELECT o_orderkey AS receipt_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS extracted_total, CAST(s AS DOUBLE) AS raw_total, c_name AS cleaned_name, s IS NOT NULL AS has_raw, c_custkey IS NOT NULL AS has_cleaned
FROM orders LEFT JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) ON c_custkey = o_custkey""")
def extraction_with_sources(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("order")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("raw_total"))
    clean = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("cleaned_name"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_custkey").alias("customer"), F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("extracted_total"))
    out = scoring.with_sources(rows, {"has_raw": (raw, "order"), "has_cleaned": (clean, "customer")})
    return out.select(F.col("order").alias("receipt_id"), "extracted_total", F.col("raw_total").cast("double").alias("raw_total"), "cleaned_name", "has_raw", "has_cleaned")


@query(f"""SELECT t.receipt_id, CASE WHEN (v.value IS NULL) AND (d.value IS NULL) AND (t.value IS NULL) AND n IS NULL THEN 'failed' WHEN v.value IS NULL OR d.value IS NULL OR t.value IS NULL OR n IS NULL THEN 'partial' ELSE 'success' END AS status,
  array_to_string(list_filter([CASE WHEN v.value IS NULL THEN 'vendor_missing' END, CASE WHEN d.value IS NULL THEN 'date_missing' END, CASE WHEN t.value IS NULL THEN 'total_missing' END, CASE WHEN n IS NULL THEN 'items_missing' END,
    CASE WHEN n > 0 AND abs(s - t.value) > greatest(1.0, t.value * 0.05) THEN 'item_sum_total_mismatch' END], lambda x: x IS NOT NULL), ';') AS warnings, coalesce(n, 0) AS item_count
FROM ({ORACLES['extract_total']}) t LEFT JOIN ({ORACLES['extract_vendor']}) v ON v.receipt_id = t.receipt_id LEFT JOIN ({ORACLES['extract_date']}) d ON d.receipt_id = t.receipt_id
LEFT JOIN (SELECT receipt_id, count(*) AS n, sum(price) AS s FROM ({ORACLES['extract_items']}) GROUP BY 1) i ON i.receipt_id = t.receipt_id""")
def extraction_status(spark, sf_dir):
    out = extraction.extract(receipts(spark, sf_dir))
    return out.select("receipt_id", "status", F.array_join("warnings", ";").alias("warnings"), F.col("item_count").cast("bigint").alias("item_count"))


@query(None)
def canonical_documents(spark, sf_dir):
    """Printed receipts through extraction, scoring and canonical JSON; unit tests hold the parts, this query the whole plan."""
    from tallyforge.plans.inference import from_lines

    docs = from_lines(receipts(spark, sf_dir).withColumn("source_file", F.concat("receipt_id", F.lit(".json"))))
    return docs.select("receipt_id", "store_name", "date", F.col("total_amount").cast("double").alias("total_amount"), F.size("items").alias("item_count"), "overall_confidence", "reliability", "review_required",
                       F.array_join("conflicts", ";").alias("conflicts"), F.col("_validation.status").alias("status"))
