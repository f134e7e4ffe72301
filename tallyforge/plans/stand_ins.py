"""Receipt-shaped views of the driver tables, in SQL that Spark and DuckDB both run.

Every value is a rule over keys, so both engines see the same rows. ``{orders}`` and so on are
filled in with a table (DuckDB) or a DataFrame (Spark).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RECEIPTS = """
SELECT CAST(o_orderkey - CASE WHEN o_orderkey % 29 = 1 THEN 1 ELSE 0 END AS STRING) AS receipt_id,
  lpad(CAST(o_orderkey AS STRING), 12, '0') || '.json' AS source_file,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL
       WHEN o_orderkey % 7 = 1 THEN '  ' || upper(c_mktsegment) || '-mart   ' || CAST(o_custkey % 50 AS STRING) || '  '
       WHEN o_orderkey % 7 = 2 THEN c_mktsegment || ' Mart, ' || CAST(o_custkey % 50 AS STRING)
       ELSE lower(c_mktsegment) || ' mart ' || CAST(o_custkey % 50 AS STRING) END AS store_name,
  CASE WHEN o_orderkey % 53 = 0 THEN '2024-02-30' WHEN o_orderkey % 59 = 0 THEN '01/02/2024'
       WHEN o_orderkey % 61 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'abc' WHEN o_orderkey % 37 = 0 THEN '(50)'
       WHEN o_orderkey % 5 = 0 THEN 'Rs. ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)
       WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey % 9 + 1 AS STRING) || ',234.565'
       ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS total_amount,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN 'abc' WHEN o_orderkey % 47 = 0 THEN '1.5'
       ELSE CAST(CAST((o_orderkey * 37 % 101) * 0.01 AS DECIMAL(10,2)) AS STRING) END AS overall_confidence,
  CASE WHEN o_orderkey % 13 = 0 THEN 'yes' WHEN o_orderkey % 13 = 1 THEN 'No' ELSE NULL END AS review_required,
  CASE WHEN o_orderkey % 19 = 0 THEN 'failed' WHEN o_orderkey % 19 = 1 THEN NULL ELSE 'passed' END AS validation_status
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""

#: Items of an order in a fixed order; ``pos`` from 0.
ITEMS = """
SELECT l_orderkey AS receipt_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) - 1 AS INT) AS pos,
  p_name || CASE WHEN l_linenumber % 2 = 0 THEN ' large' ELSE ' box' END AS name,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l_quantity AS INT) AS quantity
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""

#: Predicted and true receipts of the same orders, with edits, gaps and repeated ids.
PREDICTED = """
SELECT o_orderkey - CASE WHEN o_orderkey % 31 = 1 THEN 1 ELSE 0 END AS receipt_id,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 6 = 1 THEN upper(c_mktsegment) || '  MART' ELSE c_mktsegment || ' mart' END AS store_name,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN '1999-01-01' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date,
  CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 14 = 1 THEN '12.00' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS total_amount,
  CAST((o_orderkey * 37 % 101) * 0.01 AS DOUBLE) AS confidence
FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 12 <> 5
"""
TRUTH = """
SELECT o_orderkey - CASE WHEN o_orderkey % 37 = 1 THEN 1 ELSE 0 END AS receipt_id,
  CASE WHEN o_orderkey % 15 = 2 THEN NULL ELSE c_mktsegment || ' Mart' END AS store_name,
  CASE WHEN o_orderkey % 16 = 3 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date,
  CASE WHEN o_orderkey % 18 = 4 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS total_amount
FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderkey % 11 <> 7
"""

#: Predicted items: some dropped, some renamed, some repriced. Positions make pairs unique where names repeat.
PRED_ITEMS = """
SELECT receipt_id, pos, CASE WHEN (receipt_id + pos) % 5 = 0 THEN replace(name, 'large', 'larg') WHEN (receipt_id + pos) % 7 = 0 THEN 'other thing' ELSE name END AS name,
  price + CASE WHEN (receipt_id + pos) % 9 = 0 THEN 1.00 WHEN (receipt_id + pos) % 11 = 0 THEN 0.01 ELSE 0.00 END AS price
FROM ({items}) i WHERE (receipt_id + pos) % 8 <> 3
"""

#: Lines of a printed receipt per order: store, date, items, total, in shapes picked by the key. First those above the items, by place.
ABOVE = {
    0: "CASE WHEN o_orderkey % 4 = 0 THEN 'STORE: ' || c_mktsegment || ' MART' WHEN o_orderkey % 4 = 1 THEN c_mktsegment || ' MART' WHEN o_orderkey % 4 = 2 THEN 'RECEIPT COPY' ELSE 'REF 12 34' END",
    1: "CASE WHEN o_orderkey % 4 = 2 THEN c_mktsegment || ' SHOPPING' WHEN o_orderkey % 4 = 3 THEN 'Tel 123' ELSE 'WELCOME' END",
    2: """CASE
    WHEN o_orderkey % 5 = 0 THEN 'DATE: ' || lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '/' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '/' || CAST(year(o_orderdate) AS STRING)
    WHEN o_orderkey % 5 = 1 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) || ' 12:30'
    WHEN o_orderkey % 5 = 2 THEN 'REF 7 ' || CAST(day(o_orderdate) AS STRING) || '.' || CAST(month(o_orderdate) AS STRING) || '.' || substr(CAST(year(o_orderdate) AS STRING), 3, 2)
    WHEN o_orderkey % 5 = 3 THEN 'DATE 31/02/2024' ELSE 'NO DAY HERE' END""",
}
BELOW = {
    99: "'AMT 7.25'",
    100: """CASE WHEN o_orderkey % 6 = 0 THEN 'GRAND TOTAL ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) WHEN o_orderkey % 6 = 1 THEN 'TOTAL'
    WHEN o_orderkey % 6 = 2 THEN 'SUBTOTAL 1.00' WHEN o_orderkey % 6 = 3 THEN 'NET AMOUNT Rs. ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)
    WHEN o_orderkey % 6 = 4 THEN 'BALANCE DUE 10.00' ELSE 'THE END' END""",
    101: """CASE WHEN o_orderkey % 6 = 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)
    WHEN o_orderkey % 6 = 2 THEN 'TOTAL DUE ' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) WHEN o_orderkey % 6 = 4 THEN 'CASH 50.00' ELSE 'PAID' END""",
}
PRINTED = "{orders} JOIN {customer} ON o_custkey = c_custkey"
ITEM_LINES = """SELECT receipt_id, 3 + pos AS pos, CASE WHEN pos % 4 = 3 THEN upper(name) || ' ' || CAST(quantity AS STRING) || 'x' || CAST(price AS STRING)
    WHEN pos % 4 = 2 THEN upper(name) || ' Rs ' || CAST(price AS STRING) ELSE upper(name) || ' ' || CAST(price AS STRING) END AS line FROM ({items}) i"""
LINES = ITEM_LINES + "".join(f"\nUNION ALL SELECT o_orderkey, {pos}, {line} FROM {PRINTED}" for pos, line in (ABOVE | BELOW).items())
#: The same, an array above and an array below the items: orders are read once.
FRAMES = f"SELECT o_orderkey AS receipt_id, array({', '.join(ABOVE.values())}) AS above, array({', '.join(BELOW.values())}) AS below FROM {PRINTED}"

TABLES = ("orders", "customer", "lineitem", "part", "documents", "events", "pages", "benchmark", "embeddings", "supplier", "conversations")


def _nested(sql: str) -> str:
    return sql.replace("{items}", ITEMS.strip())


def oracle(sql: str) -> str:
    """The view as DuckDB SQL over the registered tables."""
    return re.sub(r"\{(\w+)\}", r"\1", _nested(sql)).strip()


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The view as a DataFrame over the Parquet tables; only the columns it names are read."""
    sql = _nested(sql)
    used = {t for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
