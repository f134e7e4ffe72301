"""Text queries: cleaning steps, names, redaction, distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import arrow
from tallyforge.functions import text as T
from tallyforge.functions import values as V
from tallyforge.operators import cleaning, dedup, evaluation, extraction, scoring
from tallyforge.plans.registry import query
from tallyforge.plans.stand_ins import oracle, table, view
from tallyforge.sources import files

#: Lines as a recogniser might misread them.
MISREAD = """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'T0TAL' WHEN 1 THEN 'GRAND  T0TAL ' || CAST(o_custkey AS STRING) WHEN 2 THEN 'T0TAL: ' || CAST(o_custkey AS STRING) WHEN 3 THEN 'AM0UNT PAYABLE' WHEN 4 THEN 'R3CEIPT'
  WHEN 5 THEN 'Rs. ' || CAST(o_custkey AS STRING) || ' and INR ' || CAST(o_custkey AS STRING) WHEN 6 THEN 'RS 120' WHEN 7 THEN 'pay I N R now' WHEN 8 THEN 'INVCICE' ELSE 'Milk 40' END AS line FROM {orders}"""


@query("SELECT doc_id, sha256(nfc_normalize(text)) AS sha256 FROM documents")
def nfkc_normalize(spark, sf_dir):
    """Texts with a ligature, full-width digits and a decomposed letter put in, which NFKC takes out again."""
    text = F.replace(F.replace("text", F.lit("fi"), F.lit("\ufb01")), F.lit("\u00e9"), F.lit("e\u0301"))
    wide = F.translate(text, "0123456789", "".join(chr(0xFF10 + i) for i in range(10)))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.nfkc(wide), 256).alias("sha256"))


@query("SELECT doc_id, sha256(replace(text, ' ', chr(9))) AS sha256 FROM documents")
def control_strip(spark, sf_dir):
    text = F.replace("text", F.lit(" "), F.lit("\x07\u200b\t\x00"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.drop_controls(text), 256).alias("sha256"))


NESTED = """SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '{{broken' ELSE '{{"k": ' || CAST(event_id AS STRING) || ', "Api-Key": "' || event_type || '", "rows": [{{"Session Token": 1.5, "name": "é"}}, [2, {{"user_password": null}}]], "n": null}}' END AS raw FROM {events}"""


@query("""SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN '{"k": ' || event_id || ', "Api-Key": "***", "rows": [{"Session Token": "***", "name": "é"}, [2, {"user_password": "***"}]], "n": null}' END AS clean FROM events""")
def redact_nested(spark, sf_dir):
    rows = view(spark, sf_dir, NESTED)
    return rows.select("event_id", arrow.redact_json(F.col("raw")).alias("clean"))


LINES_SQL = "list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))"


@query(f"SELECT doc_id, sha256(array_to_string(list_filter(list_transform({LINES_SQL}, lambda x: regexp_replace(x, '[ \\t]+', ' ', 'g')), lambda x: x <> ''), chr(10))) AS sha256 FROM documents")
def whitespace_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_whitespace(F.col("text")), 256).alias("sha256"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'TOTAL' WHEN 1 THEN 'GRAND TOTAL ' || substr(line, 14) WHEN 2 THEN replace(line, 'T0TAL', 'TOTAL') WHEN 3 THEN 'AMOUNT PAYABLE' WHEN 4 THEN 'RECEIPT' WHEN 8 THEN 'INVOICE' ELSE line END AS line
FROM ({oracle(MISREAD)})""")
def ocr_error_correction(spark, sf_dir):
    return view(spark, sf_dir, MISREAD).select("o_orderkey", T.correct_errors(F.col("line")).alias("line"))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, '!!', '!!!'), '\\.{3,}', '.', 'g'), ',{3,}', ',', 'g'), ':{3,}', ':', 'g'), ';{3,}', ';', 'g'), '!{3,}', '!', 'g'), '\\?{3,}', '?', 'g')) AS sha256 FROM documents""")
def punctuation_squeeze(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.squeeze_punctuation(F.replace("text", F.lit("!!"), F.lit("!!!"))), 256).alias("sha256"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 5 THEN regexp_replace(line, '(?i)(?:₹|rs\\.?|inr)\\s*(\\d)', '\\1', 'g') WHEN 6 THEN '120' WHEN 7 THEN 'pay  now' ELSE line END AS line FROM ({oracle(MISREAD)})""")
def currency_strip(spark, sf_dir):
    return view(spark, sf_dir, MISREAD).select("o_orderkey", T.strip_currency(F.col("line")).alias("line"))


@query(f"""SELECT doc_id, len(ls) AS lines, sha256(array_to_string(ls, chr(10))) AS sha256 FROM (SELECT doc_id, list_filter({LINES_SQL.replace('text', 't')}, lambda x: x <> '' AND NOT regexp_full_match(x, '[\\s\\-_=*~.]{{4,}}')) AS ls
  FROM (SELECT doc_id, replace(text, chr(10), chr(10) || CASE WHEN doc_id % 2 = 0 THEN '-----' ELSE ' ' END || chr(10)) AS t FROM documents))""")
def noise_line_filter(spark, sf_dir):
    rule = F.when(F.col("doc_id") % 2 == 0, "-----").otherwise(" ")
    t = F.replace("text", F.lit("\n"), F.concat(F.lit("\n"), rule, F.lit("\n")))
    out = table(spark, sf_dir, "documents").select("doc_id", T.drop_noise_lines(t).alias("t"))
    return out.select("doc_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("bigint").alias("lines"), F.sha2("t", 256).alias("sha256"))


@query("""WITH l AS (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || 'Milk 40' || chr(10) || 'Milk 40 ' || chr(10)), chr(10)) AS ls FROM documents)
SELECT doc_id, len(k) AS lines, sha256(array_to_string(k, chr(10))) AS sha256 FROM (SELECT doc_id, list_filter(ls, lambda x, i: i = 1 OR trim(x) <> trim(ls[i - 1])) AS k FROM l)""")
def adjacent_line_dedup(spark, sf_dir):
    t = F.replace("text", F.lit("\n"), F.lit("\nMilk 40\nMilk 40 \n"))
    out = table(spark, sf_dir, "documents").select("doc_id", T.drop_adjacent_repeats(t).alias("t"))
    return out.select("doc_id", F.size(F.split("t", "\n")).cast("bigint").alias("lines"), F.sha2("t", 256).alias("sha256"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'TOTAL' WHEN 1 THEN 'GRAND TOTAL ' || CAST(o_custkey AS VARCHAR) WHEN 2 THEN 'TOTAL: ' || CAST(o_custkey AS VARCHAR) WHEN 3 THEN 'AMOUNT PAYABLE' WHEN 4 THEN 'RECEIPT'
  WHEN 5 THEN CAST(o_custkey AS VARCHAR) || ' and ' || CAST(o_custkey AS VARCHAR) WHEN 6 THEN '120' WHEN 7 THEN 'pay  now' WHEN 8 THEN 'INVOICE' ELSE 'Milk 40' END AS cleaned,
  CASE o_orderkey % 10 WHEN 1 THEN 'whitespace_normalization;common_ocr_correction' WHEN 5 THEN 'currency_normalization' WHEN 6 THEN 'currency_normalization' WHEN 7 THEN 'currency_normalization' WHEN 9 THEN '' ELSE 'common_ocr_correction' END || CASE WHEN o_orderkey % 10 = 9 THEN 'adjacent_duplicate_removal' ELSE '' END AS changes FROM orders""")
def clean_text(spark, sf_dir):
    lines = view(spark, sf_dir, MISREAD).withColumn("line", F.when(F.col("o_orderkey") % 10 == 9, "Milk 40\nMilk 40").otherwise(F.col("line")))
    out = cleaning.clean_text(lines, "line", unicode=False)
    return out.select("o_orderkey", "cleaned", F.array_join("changes", ";").alias("changes"))


STORE = "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '  ' || lower(c_mktsegment) || '--mart!! ' WHEN 1 THEN c_name WHEN 2 THEN '' WHEN 3 THEN '***' ELSE c_mktsegment || '&' || c_name END AS name FROM {customer}"


@query(f"SELECT id, CASE WHEN trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) <> '' THEN trim(regexp_replace(upper(name), '[^A-Z0-9]+', ' ', 'g')) ELSE '__UNKNOWN_STORE__' END AS store_key FROM ({oracle(STORE)})")
def canonical_store(spark, sf_dir):
    return view(spark, sf_dir, STORE).select("id", T.canonical_store(F.col("name")).alias("store_key"))


#: Compared text in DuckDB: case folded (of the tables' letters only the sharp s folds beyond lower case), white space squeezed.
FOLDED = "trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace({FOLDED}, '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS sha256 FROM documents")
def eval_text_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.evaluation_text(F.col("text"), punctuation=True), 256).alias("sha256"))


@query("""SELECT page_id, substr(CASE WHEN t <> '' THEN t ELSE 'unnamed' END, 1, 250) AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '[^A-Za-z0-9_.\\-/ ]+', '_', 'g'), '\\s+', '_', 'g'), '^[._\\-/]+|[._\\-/]+$', '', 'g') AS t FROM pages)""")
def sanitize_name(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.sanitize_name(F.col("url")).alias("name"))


_R = """regexp_replace(regexp_replace(regexp_replace(text, '([a-zA-Z][a-zA-Z0-9+.-]*://)([^/@\\s:]+):([^/@\\s]+)@', '\\1***:***@', 'g'), '(?i)\\b(bearer)\\s+[A-Za-z0-9._~+/=-]+', '\\1 ***', 'g'), '(?i)\\b(token|api[_-]?key|secret)\\s*=\\s*([^\\s&;]+)', '\\1=***', 'g')"""


@query(f"WITH t AS (SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations) SELECT id, sha256({_R}) AS sha256, text <> {_R} AS changed FROM t")
def redact_secrets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    r = T.redact(F.col("text"))
    return d.unionAll(c).select("id", F.sha2(r, 256).alias("sha256"), (F.col("text") != r).alias("changed"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\p{Nd}]', '', 'g')) AS digits FROM documents")
def char_class_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.letters(t).cast("bigint").alias("letters"), T.digits(t).cast("bigint").alias("digits"))


#: Whole words of digits with an optional decimal part, so that look-around and \\b agree.
AMOUNT_TEXT = "SELECT l_orderkey, l_linenumber, l_partkey, 'QTY ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' AT Rs. ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS STRING) || ' OF 1,250.50 AT 12:30 END' AS line FROM {lineitem}"


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) || '.0;' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ';1250.50' AS amounts FROM lineitem")
def extract_amounts(spark, sf_dir):
    found = F.transform(V.amounts(F.col("line")), lambda x: x.cast("decimal(18,2)").cast("string"))
    first = F.concat(F.split(F.get(found, F.lit(0)), r"\.")[0], F.lit(".0"))
    joined = F.concat_ws(";", first, F.array_join(F.slice(found, 2, 10), ";"))
    return view(spark, sf_dir, AMOUNT_TEXT).select("l_orderkey", "l_linenumber", "l_partkey", joined.alias("amounts"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS text FROM documents")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.truncate(F.col("text"), 120).alias("text"))


@query("""SELECT page_id, regexp_extract(url, '([^/]+?)(\\.[^./]*)?$', 1) AS stem, lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix,
  CASE lower(regexp_extract(url, '(\\.[^./]+)$', 1)) WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' WHEN '.png' THEN 'image/png' WHEN '.bmp' THEN 'image/bmp' WHEN '.tif' THEN 'image/tiff' WHEN '.tiff' THEN 'image/tiff' WHEN '.webp' THEN 'image/webp' END AS mime_type FROM pages""")
def path_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", files.stem(u).alias("stem"), files.suffix(u).alias("suffix"), files.mime_type(u).alias("mime_type"))


@query("""SELECT page_id, coalesce(nullif(split_part(regexp_extract(url, '^https?://[^/]+([^?#]*)', 1), '/en/', 2).split('/')[1], ''), nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '')) AS file_id FROM pages""")
def url_file_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.url_file_id(F.col("url"), "/en/", "utm_source").alias("file_id"))


#: Whole turns as compared texts, and damaged copies: in some turns words become one that no text has, in some words go.
DAMAGED = f"""SELECT conv_id, turn, r, array_to_string(list_filter(list_transform(ws, lambda w, i: CASE WHEN i % 7 = 4 AND turn % 2 = 1 THEN 'xq' ELSE w END), lambda w, i: NOT (i % 11 = 6 AND conv_id % 3 = 1)), ' ') AS h, len(ws) AS words
FROM (SELECT conv_id, turn, {FOLDED} AS r, string_split({FOLDED}, ' ') AS ws FROM conversations) t"""
#: Letters beyond ASCII as capitals, which folded texts lack: the distance there counts bytes.
_BYTES = "translate({c}, 'éèüêçäöóñí', 'ABCDEFGHIJ')"
CER = f"SELECT conv_id, turn, levenshtein({_BYTES.format(c='r')}, {_BYTES.format(c='h')}) AS distance, length(r) AS length FROM ({DAMAGED})"
#: Each foreign word takes an edit and each missing one another, and so many are enough.
WER = f"SELECT conv_id, turn, len(list_filter(string_split(h, ' '), lambda w: w = 'xq')) + words - len(string_split(h, ' ')) AS distance, words FROM ({DAMAGED})"


def damaged(spark, sf_dir):
    text = T.evaluation_text(F.col("text"))
    # a distance costs the square of a text's length, so the rows of a small file go over all cores
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "turn")
    rows = turns.select("conv_id", "turn", text.alias("r"), F.split(text, " ").alias("ws"))
    swapped = F.transform("ws", lambda w, i: F.when((i % 7 == 3) & (F.col("turn") % 2 == 1), "xq").otherwise(w))
    return rows.select("conv_id", "turn", "r", F.array_join(F.filter(swapped, lambda w, i: ~((i % 11 == 5) & (F.col("conv_id") % 3 == 1))), " ").alias("h"))


@query(f"SELECT conv_id, turn, distance, length, round(distance / greatest(1, length), 6) AS cer FROM ({CER})")
def cer_per_document(spark, sf_dir):
    return evaluation.error_rates(damaged(spark, sf_dir), "r", "h").select("conv_id", "turn", F.col("char_distance").alias("distance"), F.col("reference_chars").alias("length"), "cer")


@query(f"SELECT CAST(sum(distance) AS BIGINT) AS edits, CAST(sum(length) AS BIGINT) AS reference, round(sum(distance) / greatest(1, sum(length)), 6) AS corpus_cer FROM ({CER})")
def corpus_cer(spark, sf_dir):
    return evaluation.corpus_metric(cer_per_document(spark, sf_dir), "distance", "length", "corpus_cer")


@query(f"SELECT conv_id, turn, distance, words, round(distance / greatest(1, words), 6) AS wer FROM ({WER})")
def wer_per_document(spark, sf_dir):
    return evaluation.error_rates(damaged(spark, sf_dir), "r", "h").select("conv_id", "turn", F.col("word_distance").alias("distance"), F.col("reference_words").alias("words"), "wer")


@query(f"SELECT CAST(sum(distance) AS BIGINT) AS edits, CAST(sum(words) AS BIGINT) AS reference, round(sum(distance) / greatest(1, sum(words)), 6) AS corpus_wer FROM ({WER})")
def corpus_wer(spark, sf_dir):
    return evaluation.corpus_metric(wer_per_document(spark, sf_dir), "distance", "words", "corpus_wer")


NAMES = "SELECT p_partkey, lower(p_name) AS a, lower(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, 'l', '1') ELSE p_brand END) AS b FROM {part}"


@query(f"SELECT p_partkey, round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS similarity FROM ({oracle(NAMES)})")
def name_similarity(spark, sf_dir):
    return view(spark, sf_dir, NAMES).select("p_partkey", F.round(T.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


ITEM_NAMES = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'TOTAL ' || p_name WHEN 1 THEN p_name || ' 12345' WHEN 2 THEN '# ' || p_name WHEN 3 THEN 'x' WHEN 4 THEN ' ,' || p_name || '- ' WHEN 5 THEN '12 Main Street' WHEN 6 THEN 'tenders' WHEN 7 THEN '12:30' ELSE p_name END AS name FROM {part}"


@query(f"""SELECT p_partkey, length(n) BETWEEN 2 AND 80 AND NOT regexp_matches(upper(n), 'TOTAL|TAX|VAT|GST|DISCOUNT|CHANGE|PAYMENT|CARD|DEBIT|CREDIT|REF|ACCOUNT|NETWORK|TERMINAL|APPR|CODE|STORE HOURS|ITEMS SOLD|SAVE MONEY|THANK YOU|CASHIER|MANAGER|EFT|TEND|BALANCE|PAY FROM|PURCHASE')
  AND NOT regexp_matches(n, '\\b\\d{{5,}}\\b') AND NOT regexp_matches(n, '(?i)\\b\\d+\\s+[A-Z][A-Z0-9\\- ]{{2,}}\\b') AND NOT regexp_matches(n, '(?i)\\b(?:ST|STREET|ROAD|RD|AVE|AVENUE|DR|DRIVE|BLVD|LN|LANE|CT|COURT|CIR|HIGHWAY|HWY)\\b')
  AND NOT regexp_matches(n, '[#@]') AND length(regexp_replace(n, '[^A-Za-z]', '', 'g')) >= 2 AND length(regexp_replace(n, '[^0-9]', '', 'g')) <= greatest(3, floor(length(regexp_replace(n, '[^A-Za-z]', '', 'g')) * 0.35)) AS valid
FROM (SELECT p_partkey, trim(regexp_replace(trim(name), '^[\\s:|,\\-]+|[\\s:|,\\-]+$', '', 'g')) AS n FROM ({oracle(ITEM_NAMES)}))""")
def item_name_valid(spark, sf_dir):
    return view(spark, sf_dir, ITEM_NAMES).select("p_partkey", extraction.valid_item_name(F.col("name")).alias("valid"))


@query("""WITH w AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS first, string_split(text, chr(10)) AS ls FROM documents),
n AS (SELECT doc_id, list_transform(ls, lambda x: trim(regexp_replace(lower(x), '\\s+', ' ', 'g'))) AS ls, trim(regexp_replace(lower(CASE WHEN doc_id % 3 = 0 THEN ls[1] WHEN doc_id % 3 = 1 THEN substr(ls[len(ls)], 1, 12) ELSE 'no such words' END), '\\s+', ' ', 'g')) AS v, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS i FROM w)
SELECT doc_id, CASE WHEN i < len(ls) AND ls[i + 1] = v THEN 'indexed_exact_value' WHEN i < len(ls) AND (contains(ls[i + 1], v) OR contains(v, ls[i + 1])) THEN 'indexed_partial_match'
  WHEN list_contains(ls, v) THEN 'global_exact_value' WHEN len(list_filter(ls, lambda x: contains(x, v) OR contains(v, x))) > 0 THEN 'global_partial_match' ELSE 'receipt_level_fallback' END AS method FROM n""")
def best_region_match(spark, sf_dir):
    lines = F.split("text", "\n")
    regions = F.transform(lines, lambda x: F.struct(x.alias("cleaned_text"), F.lit(0.9).alias("confidence")))
    value = F.when(F.col("doc_id") % 3 == 0, F.get(lines, F.lit(0))).when(F.col("doc_id") % 3 == 1, F.substring(F.element_at(lines, -1), 1, 12)).otherwise("no such words")
    made = scoring.best_region(regions, value, F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, 0).otherwise(1))
    return table(spark, sf_dir, "documents").select("doc_id", made["method"].alias("method"))
