"""Scalar and array queries: numbers, dates, flags, JSON, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tallyforge.config import Confidence
from tallyforge.functions import values as V
from tallyforge.operators import cleaning, dedup, regions, scoring, tracking
from tallyforge.plans.registry import query
from tallyforge.plans.stand_ins import ITEMS, RECEIPTS, oracle, table, view
from tallyforge.sources import files, images
from tallyforge.streaming import receipts as streaming


@query("SELECT doc_id, source, n_chars FROM documents WHERE source IN ('src1', 'src3', 'src5') AND n_chars BETWEEN 200 AND 5000 ORDER BY source, doc_id")
def scan_filter_sorted(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src3", "src5") & F.col("n_chars").between(200, 5000))
    return rows.select("doc_id", "source", "n_chars").orderBy("source", "doc_id")


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 AND json_valid(props) THEN try_cast(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 10 = 0 AS corrupt FROM events")
def json_scan_permissive(spark, sf_dir):
    raw = F.when(F.col("event_id") % 10 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    made = files.parsed(table(spark, sf_dir, "events").select("event_id", raw.alias("raw")), "raw", StructType().add("k", LongType()))
    return made.select("event_id", "k", F.col("_corrupt").isNotNull().alias("corrupt"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", files.content_hash(F.col("text")).alias("sha256"))


_UP = "SELECT o // 1000 AS o, sum(n) AS n, sha256(string_agg(h, '' ORDER BY o)) AS h FROM"


@query(f"""WITH a AS ({_UP} (SELECT doc_id AS o, 1 AS n, sha256(text) AS h FROM documents) GROUP BY o // 1000), b AS ({_UP} a GROUP BY o // 1000), c AS ({_UP} b GROUP BY o // 1000)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(h, '' ORDER BY o)) AS fingerprint FROM c""")
def dataset_fingerprint(spark, sf_dir):
    return files.fingerprint(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""WITH w AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS events, round(avg(value), 6) AS mean, max(value) AS greatest FROM events GROUP BY event_type)
SELECT event_type, key, value FROM w UNPIVOT (value FOR key IN (events, mean, greatest))""")
def metrics_long_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("greatest"))
    return tracking.unpivoted(wide, ["event_type"], ["events", "mean", "greatest"])


#: Images as a dataset folder might hold them: PNG headers of sizes that repeat, some files cut, empty, or of another suffix.
_BIG = "lpad(hex({n}), 8, '0')"
PICTURES = f"""SELECT lpad(CAST(doc_id AS STRING), 12, '0') || CASE WHEN doc_id % 13 = 0 THEN '.gif' ELSE '.PNG' END AS path, CASE WHEN doc_id % 11 = 0 THEN unhex('') WHEN doc_id % 7 = 0 THEN unhex('89504E47')
  ELSE unhex('89504E470D0A1A0A0000000D49484452' || {_BIG.format(n="doc_id % 50 + 1")} || {_BIG.format(n="doc_id % 20 + 1")} || '0802000000') END AS content FROM {{documents}}"""


@query(f"""WITH p AS (SELECT doc_id, lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 4 ELSE 29 END AS size, CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 THEN doc_id % 50 + 1 END AS w, CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 THEN doc_id % 20 + 1 END AS h,
  doc_id % 13 <> 0 AS known FROM documents), d AS (SELECT *, row_number() OVER (PARTITION BY size, w, h ORDER BY path) > 1 AS dup FROM p)
SELECT count(*) AS total, count(*) FILTER (known AND size = 29) AS valid, count(*) FILTER (size = 4) AS is_corrupt, count(*) FILTER (size = 0) AS is_empty, count(*) FILTER (dup) AS is_duplicate, round(count(*) FILTER (known AND size = 29) / count(*), 6) AS validity_rate, round(sum(size) / 1048576, 4) AS size_mb,
  CAST(min(w) AS INTEGER) AS min_width, CAST(max(w) AS INTEGER) AS max_width, round(avg(w), 6) AS mean_width, CAST(min(h) AS INTEGER) AS min_height, CAST(max(h) AS INTEGER) AS max_height, round(avg(h), 6) AS mean_height FROM d""")
def data_validation_stats(spark, sf_dir):
    found = view(spark, sf_dir, PICTURES).withColumn("length", F.length("content").cast("bigint"))
    out = images.statistics(images.validate(found))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_width", "mean_height")})


@query("""SELECT l_orderkey AS receipt_id, count(*) AS regions, count(*) FILTER (l_discount * 10 BETWEEN 0.30 AND 1.0 AND l_returnflag <> 'N') AS kept FROM lineitem GROUP BY 1""")
def ocr_region_filter(spark, sf_dir):
    one = F.struct(F.when(F.col("l_returnflag") == "N", " ").otherwise(F.col("l_returnflag")).alias("text"), (F.col("l_discount") * 10).alias("confidence"), F.array().cast("array<array<double>>").alias("bbox"))
    packed = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("receipt_id"), one.alias("r")).groupBy("receipt_id").agg(F.collect_list("r").alias("rs"))
    return packed.select("receipt_id", F.size("rs").cast("bigint").alias("regions"), F.size(regions.kept(F.col("rs"))).cast("bigint").alias("kept"))


CONF = "CAST((o_orderkey * 37 % 101) * 0.01 AS DOUBLE)"


@query(f"SELECT o_orderkey, CASE WHEN {CONF} >= 0.90 THEN 'high' WHEN {CONF} >= 0.70 THEN 'medium' ELSE 'low' END AS reliability FROM orders")
def reliability_tier(spark, sf_dir):
    c = F.expr("CAST((o_orderkey * 37 % 101) * 0.01 AS DOUBLE)")
    return table(spark, sf_dir, "orders").select("o_orderkey", V.tier(c).alias("reliability"))


@query(f"SELECT o_orderkey, {CONF} < 0.70 OR o_orderkey % 9 = 0 OR o_orderpriority = '1-URGENT' AS review_required FROM orders")
def review_flag(spark, sf_dir):
    conf = F.expr("CAST((o_orderkey * 37 % 101) * 0.01 AS DOUBLE)")
    return table(spark, sf_dir, "orders").select("o_orderkey", (scoring.review(conf, F.col("o_orderkey") % 9 == 0) | (F.col("o_orderpriority") == "1-URGENT")).alias("review_required"))


@query("""WITH s AS (SELECT l_returnflag AS flag, l_linenumber AS n, 0.5 * (l_discount * 10) + 0.3 * (0.7 * (1 - l_tax) + 0.3 * (l_quantity / 50)) + 0.2 * 0.8 AS s FROM lineitem),
t AS (SELECT flag, n, CASE WHEN flag = 'R' THEN s * 0.85 ELSE s END * (1 - CASE WHEN n % 2 = 0 THEN 0.2 ELSE 0.0 END) AS s FROM s)
SELECT flag, n AS l_linenumber, round(avg(greatest(0.0, least(1.0, s))), 6) AS confidence FROM t GROUP BY 1, 2""")
def confidence_combine(spark, sf_dir):
    penalty = F.when(F.col("l_linenumber") % 2 == 0, 0.2).otherwise(0.0)
    c = scoring.combine(F.col("l_discount") * 10, F.col("l_quantity") / 50, 1 - F.col("l_tax"), F.lit(0.8), F.col("l_returnflag") == "R", penalty, Confidence(digits=12))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_linenumber").agg(F.round(F.avg(c), 6).alias("confidence"))


@query("SELECT event_id, round(greatest(0.0, least(1.0, value / 300)), 4) AS confidence, value / 300 BETWEEN 0 AND 1 AS valid FROM events")
def confidence_clip(spark, sf_dir):
    made = V.confidence((F.col("value") / 300).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", made["value"].alias("confidence"), made["valid"].alias("valid"))


SHOWN = "CASE event_id % 7 WHEN 0 THEN 'abc' WHEN 1 THEN NULL WHEN 2 THEN '-0.5' WHEN 3 THEN '250' ELSE CAST(event_id % 101 AS STRING) END"


@query(f"""SELECT event_id, confidence, CASE WHEN confidence IS NULL THEN '—' ELSE printf('%.1f', confidence * 100) || '%' END AS shown, CASE WHEN x IS NULL THEN '—' ELSE printf('%.2f', x) END AS amount
FROM (SELECT event_id, x, greatest(0.0, least(1.0, CASE WHEN x > 1 THEN x / 100 ELSE x END)) + x * 0 AS confidence FROM (SELECT event_id, try_cast({SHOWN} AS DOUBLE) AS x FROM events))""")
def confidence_shown(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(SHOWN).alias("raw"))
    return rows.select("event_id", V.shown_confidence(F.col("raw")).alias("confidence"), V.percent_text(F.col("raw")).alias("shown"), V.money_text(F.col("raw")).alias("amount"))


FLAG = "CASE event_id % 8 WHEN 0 THEN 'true' WHEN 1 THEN ' YES ' WHEN 2 THEN '0' WHEN 3 THEN 'No' WHEN 4 THEN event_type WHEN 5 THEN '1' WHEN 6 THEN 'n' ELSE NULL END"


@query(f"SELECT event_id, CASE WHEN lower(trim({FLAG})) IN ('true', 'yes', 'y', '1') THEN true ELSE false END AS flag FROM events")
def bool_coerce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.to_bool(F.expr(FLAG)).alias("flag"))


COUNT = "CASE event_id % 6 WHEN 0 THEN '12' WHEN 1 THEN '12.0' WHEN 2 THEN '12.5' WHEN 3 THEN '-1' WHEN 4 THEN '10001' ELSE 'x' END"


@query(f"SELECT event_id, CASE WHEN try_cast({COUNT} AS DOUBLE) = floor(try_cast({COUNT} AS DOUBLE)) AND try_cast({COUNT} AS DOUBLE) BETWEEN 0 AND 10000 THEN CAST(try_cast({COUNT} AS DOUBLE) AS INTEGER) END AS n FROM events")
def int_coerce(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.to_count(F.expr(COUNT)).alias("n"))


NUMBER = "CASE event_id % 6 WHEN 0 THEN '3.5' WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'abc' WHEN 4 THEN NULL ELSE '-7e2' END"


@query(f"SELECT event_id, CASE WHEN isfinite(try_cast({NUMBER} AS DOUBLE)) THEN try_cast({NUMBER} AS DOUBLE) ELSE 0.0 END AS x FROM events")
def safe_float(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", V.safe_float(F.expr(NUMBER), 0.0).alias("x"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k'), event_type) AS value, list_contains(json_keys(props), 'k') AS has_k, list_contains(json_keys(props), 'missing') AS has_missing FROM events")
def json_fallback_get(spark, sf_dir):
    has_k, has_missing = files.present("k", "missing")
    value = F.coalesce(files.first_given("props", "missing", "k"), F.col("event_type"))
    return files.keyed(table(spark, sf_dir, "events"), "props").select("event_id", value.alias("value"), has_k.alias("has_k"), has_missing.alias("has_missing"))


@query("""WITH r AS (SELECT vec_id, unnest(range(4)) AS pos, embedding FROM embeddings) SELECT vec_id, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < 3 THEN 't' || pos ELSE '' END AS text,
  CASE WHEN pos < 2 THEN round(CAST(embedding[pos + 1] AS DOUBLE), 5) ELSE 0.0 END AS confidence, CASE WHEN pos < 4 THEN 1 ELSE 0 END AS points FROM r""")
def zip_regions(spark, sf_dir):
    e = F.col("embedding")
    texts = F.array(*(F.lit(f"t{i}") for i in range(3)))
    polys = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.array(F.get(e, i).cast("double"), F.get(e, i + 1).cast("double"))))
    zipped = regions.from_parallel(polys, texts, F.transform(F.slice(e, 1, 2), lambda x: x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(zipped).alias("pos", "r"))
    return rows.select("vec_id", "pos", "r.text", F.round("r.confidence", 5).alias("confidence"), F.size("r.bbox").alias("points"))


@query("""WITH p AS (SELECT vec_id, CAST(unnest([embedding[1], embedding[3], embedding[5], embedding[7]]) AS DOUBLE) AS x, CAST(unnest([embedding[2], embedding[4], embedding[6], embedding[8]]) AS DOUBLE) AS y FROM embeddings)
SELECT vec_id, round(min(x), 6) AS x_min, round(min(y), 6) AS y_min, round(max(x), 6) AS x_max, round(max(y), 6) AS y_max, round(max(x) - min(x), 6) AS width, round(max(y) - min(y), 6) AS height FROM p GROUP BY vec_id""")
def bbox_extents(spark, sf_dir):
    e = F.transform("embedding", lambda x: x.cast("double"))
    box = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.array(F.get(e, 2 * i), F.get(e, 2 * i + 1)))
    made = table(spark, sf_dir, "embeddings").select("vec_id", cleaning.region_extents(box).alias("b")).select("vec_id", "b.*")
    return made.select("vec_id", *(F.round(c, 6).alias(c) for c in made.columns[1:]))


BOXES = f"SELECT receipt_id, pos, CAST(quantity * 7 AS DOUBLE) AS y_min, CAST(quantity % 5 AS DOUBLE) AS x_min, CAST(quantity % 4 * 20 AS DOUBLE) AS height FROM ({ITEMS})"


@query(f"""WITH b AS ({oracle(BOXES)}), t AS (SELECT receipt_id, greatest(10, coalesce(median(height) FILTER (height > 0) * 0.5, 20)) AS tol FROM b GROUP BY 1)
SELECT b.receipt_id, pos, row_number() OVER (PARTITION BY b.receipt_id ORDER BY round_even(y_min / tol, 0), x_min, pos) AS reading_order FROM b JOIN t ON b.receipt_id = t.receipt_id""")
def reading_order(spark, sf_dir):
    out = dedup.reading_order(view(spark, sf_dir, BOXES), "receipt_id")
    return out.select("receipt_id", "pos", F.col("reading_order").cast("bigint").alias("reading_order"))


DAY = "lpad(CAST(day(o_orderdate) AS STRING), 2, '0')"
MONTH = "lpad(CAST(month(o_orderdate) AS STRING), 2, '0')"
YEAR = "CAST(year(o_orderdate) AS STRING)"
DATES = f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN {DAY} || '/' || {MONTH} || '/' || {YEAR} WHEN 1 THEN {DAY} || '-' || {MONTH} || '-' || substr({YEAR}, 3, 2) WHEN 2 THEN {YEAR} || '/' || {MONTH} || '/' || {DAY}
  WHEN 3 THEN '45/13/2024' WHEN 4 THEN '31-02-2024' WHEN 5 THEN {YEAR} || '-' || {MONTH} || '-' || {DAY} WHEN 6 THEN 'no date' ELSE {YEAR} || '.' || CAST(month(o_orderdate) AS STRING) || '.' || CAST(day(o_orderdate) AS STRING) END AS raw,
  {YEAR} || '-' || {MONTH} || '-' || {DAY} AS iso FROM {{orders}}"""


@query(f"""SELECT o_orderkey, 'paid ' || CASE WHEN o_orderkey % 8 IN (0, 2, 5, 7) THEN iso WHEN o_orderkey % 8 = 1 THEN '20' || substr(iso, 3) WHEN o_orderkey % 8 = 4 THEN '2024-02-31' ELSE raw END || ' ok' AS text FROM ({oracle(DATES)})""")
def date_normalize(spark, sf_dir):
    return view(spark, sf_dir, DATES).select("o_orderkey", V.normalize_dates(F.concat(F.lit("paid "), "raw", F.lit(" ok"))).alias("text"))


@query(f"""WITH d AS ({oracle(DATES)}), e AS (SELECT *, CASE WHEN o_orderkey % 8 IN (2, 5, 7) THEN iso END AS ymd, CASE WHEN o_orderkey % 8 = 0 THEN iso WHEN o_orderkey % 8 = 1 THEN '20' || substr(iso, 3) END AS dmy FROM d)
SELECT o_orderkey, coalesce(ymd, dmy) AS dmy, coalesce(ymd, CASE WHEN substr(dmy, 9, 2) <= '12' THEN substr(dmy, 1, 5) || substr(dmy, 9, 2) || '-' || substr(dmy, 6, 2) END) AS mdy, ymd FROM e""")
def date_parse_ordered(spark, sf_dir):
    c = F.col("raw")
    return view(spark, sf_dir, DATES).select("o_orderkey", V.date_in_order(c, "DMY").alias("dmy"), V.date_in_order(c, "MDY").alias("mdy"), V.date_in_order(c, "YMD").alias("ymd"))


@query(f"""SELECT source_file, CASE WHEN date IS NULL THEN NULL WHEN NOT regexp_full_match(date, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'date_format_invalid' WHEN try_strptime(date, '%Y-%m-%d') IS NULL THEN 'date_invalid_calendar_value' END AS problem FROM ({oracle(RECEIPTS)})""")
def date_validate(spark, sf_dir):
    return view(spark, sf_dir, RECEIPTS).select("source_file", V.date_problem(F.col("date")).alias("problem"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 4) AS total, max(value) AS greatest FROM events GROUP BY 1, 2")
def signals_by_window(spark, sf_dir):
    out = streaming.signals(table(spark, sf_dir, "events"))
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "events", F.round("total", 4).alias("total"), "greatest")


@query("""WITH i AS (SELECT l_orderkey, round(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 2) AS s FROM lineitem GROUP BY 1),
j AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS t, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) * (1 + (o_orderkey % 25) * 0.01) ELSE CAST(s AS DOUBLE) END AS s FROM orders LEFT JOIN i ON o_orderkey = l_orderkey)
SELECT o_orderkey, CASE WHEN s IS NULL OR t IS NULL THEN 'not_evaluable' WHEN abs(s - t) <= 1.0 OR (t > 0 AND abs(s - t) / t <= 0.05) THEN 'consistent' WHEN t > 0 AND abs(s - t) / t <= 0.15 THEN 'close' ELSE 'mismatch' END AS verdict FROM j""")
def financial_consistency(spark, sf_dir):
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("s"))
    rows = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    t = F.col("o_totalprice").cast("decimal(18,2)").cast("double")
    s = F.when(F.col("o_orderkey") % 3 == 0, t * (1 + (F.col("o_orderkey") % 25) * 0.01)).otherwise(F.col("s"))
    return rows.select("o_orderkey", scoring.financial_consistency(s, t)["verdict"].alias("verdict"))
