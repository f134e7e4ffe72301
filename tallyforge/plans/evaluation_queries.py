"""Evaluation queries: predictions against truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import evaluation, matching, tracking
from tallyforge.plans.registry import query
from tallyforge.plans.stand_ins import ITEMS, PRED_ITEMS, PREDICTED, TRUTH, oracle, table, view
from tallyforge.plans.text_queries import CER, WER, corpus_cer, corpus_wer

_SIDE = "SELECT receipt_id, count(*) AS n, {cols} FROM ({sql}) GROUP BY receipt_id"
_ONCE = "CASE WHEN count(*) = 1 THEN any_value({c}) END AS {a}_{c}"
P, T_ = (["store_name", "date", "total_amount", "confidence"], ["store_name", "date", "total_amount"])
ALIGNED = f"""WITH p AS ({_SIDE.format(cols=', '.join(_ONCE.format(c=c, a='pred') for c in P), sql=oracle(PREDICTED))}), t AS ({_SIDE.format(cols=', '.join(_ONCE.format(c=c, a='truth') for c in T_), sql=oracle(TRUTH))}),
a AS (SELECT coalesce(p.receipt_id, t.receipt_id) AS receipt_id, CASE WHEN p.n IS NULL THEN 'missing' WHEN p.n > 1 THEN 'duplicate' ELSE 'available' END AS prediction_status, CASE WHEN t.n IS NULL THEN 'missing' WHEN t.n > 1 THEN 'duplicate' ELSE 'available' END AS truth_status,
  p.* EXCLUDE (receipt_id, n), t.* EXCLUDE (receipt_id, n) FROM p FULL OUTER JOIN t ON p.receipt_id = t.receipt_id),
n AS (SELECT *, trim(regexp_replace(lower(pred_store_name), '\\s+', ' ', 'g')) AS ps, trim(regexp_replace(lower(truth_store_name), '\\s+', ' ', 'g')) AS ts FROM a),
f AS (SELECT *, CASE WHEN truth_status = 'available' AND ts IS NOT NULL THEN coalesce(ps = ts, false) END AS store_correct, CASE WHEN truth_status = 'available' AND truth_date IS NOT NULL THEN coalesce(pred_date = truth_date, false) END AS date_correct,
  CASE WHEN truth_status = 'available' AND truth_total_amount IS NOT NULL THEN coalesce(abs(CAST(pred_total_amount AS DECIMAL(18,2)) - CAST(truth_total_amount AS DECIMAL(18,2))) <= 0.01, false) END AS total_correct FROM n),
e AS (SELECT *, CASE WHEN store_correct IS NOT NULL AND date_correct IS NOT NULL AND total_correct IS NOT NULL THEN store_correct AND date_correct AND total_correct END AS all_correct FROM f) """


def aligned(spark, sf_dir):
    return evaluation.align(view(spark, sf_dir, PREDICTED), view(spark, sf_dir, TRUTH))


def fields(spark, sf_dir):
    return evaluation.fields(aligned(spark, sf_dir))


@query(ALIGNED + "SELECT receipt_id, prediction_status, truth_status, pred_total_amount, truth_total_amount FROM a")
def eval_alignment(spark, sf_dir):
    return aligned(spark, sf_dir).select("receipt_id", "prediction_status", "truth_status", "pred_total_amount", "truth_total_amount")


@query(ALIGNED + "SELECT receipt_id, total_correct FROM f")
def amount_match(spark, sf_dir):
    return fields(spark, sf_dir).select("receipt_id", "total_correct")


@query(ALIGNED + """SELECT 'store' AS field, count(*) FILTER (store_correct) AS correct, count(store_correct) AS evaluable, round(count(*) FILTER (store_correct) / count(store_correct), 6) AS accuracy FROM e
UNION ALL SELECT 'date', count(*) FILTER (date_correct), count(date_correct), round(count(*) FILTER (date_correct) / count(date_correct), 6) FROM e
UNION ALL SELECT 'total', count(*) FILTER (total_correct), count(total_correct), round(count(*) FILTER (total_correct) / count(total_correct), 6) FROM e
UNION ALL SELECT 'all', count(*) FILTER (all_correct), count(all_correct), round(count(*) FILTER (all_correct) / count(all_correct), 6) FROM e""")
def field_accuracy(spark, sf_dir):
    return evaluation.accuracy(fields(spark, sf_dir), {"store": "store_correct", "date": "date_correct", "total": "total_correct", "all": "required_fields_all_correct"})


@query(ALIGNED + """SELECT count(*) FILTER (prediction_status <> 'missing') AS predictions, count(*) FILTER (truth_status <> 'missing') AS truths, count(*) AS all_ids, count(*) FILTER (prediction_status = 'missing') AS missing_predictions,
  count(*) FILTER (truth_status = 'missing') AS extra_predictions, count(*) FILTER (prediction_status = 'available' AND truth_status = 'available') AS matched, count(*) FILTER (prediction_status = 'duplicate' OR truth_status = 'duplicate') AS ambiguous FROM a""")
def eval_coverage(spark, sf_dir):
    return evaluation.coverage(aligned(spark, sf_dir))


def sides(spark, sf_dir):
    return view(spark, sf_dir, PREDICTED), view(spark, sf_dir, TRUTH)


PI, TI = f"SELECT receipt_id FROM ({oracle(PREDICTED)})", f"SELECT receipt_id FROM ({oracle(TRUTH)})"


@query(f"SELECT DISTINCT receipt_id FROM ({TI}) WHERE receipt_id NOT IN ({PI})")
def missing_predictions(spark, sf_dir):
    return evaluation.missing(*sides(spark, sf_dir))


@query(f"SELECT DISTINCT receipt_id FROM ({PI}) WHERE receipt_id NOT IN ({TI})")
def extra_predictions(spark, sf_dir):
    return evaluation.missing(*reversed(sides(spark, sf_dir)))


@query(f"SELECT DISTINCT receipt_id FROM ({PI}) WHERE receipt_id IN ({TI})")
def matched_receipts(spark, sf_dir):
    return evaluation.common(*sides(spark, sf_dir))


@query(f"{PI} UNION {TI}")
def id_union(spark, sf_dir):
    return evaluation.either(*sides(spark, sf_dir))


@query(f"{PI} INTERSECT {TI}")
def id_intersect(spark, sf_dir):
    return evaluation.common(*sides(spark, sf_dir))


@query(f"{PI} EXCEPT {TI}")
def id_except(spark, sf_dir):
    return evaluation.missing(*reversed(sides(spark, sf_dir)))


BINS = ALIGNED + """, b AS (SELECT CAST(b AS INTEGER) AS bin, b / 10 AS low, (b + 1) / 10 AS high FROM range(10) t(b)),
c AS (SELECT bin, low, high, count(pred_confidence) AS receipts, avg(pred_confidence) AS mean_confidence, avg(CAST(all_correct AS INTEGER)) AS accuracy
  FROM b LEFT JOIN (SELECT pred_confidence, all_correct FROM e WHERE pred_confidence IS NOT NULL AND all_correct IS NOT NULL) x ON pred_confidence >= low AND (pred_confidence < high OR (bin = 9 AND pred_confidence <= high)) GROUP BY ALL) """


@query(BINS + "SELECT bin, round(low, 6) AS low, round(high, 6) AS high, receipts, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM c")
def calibration_bins(spark, sf_dir):
    return evaluation.calibration(fields(spark, sf_dir), "pred_confidence", "required_fields_all_correct")


@query(BINS + "SELECT CAST(sum(receipts) AS BIGINT) AS receipts, round(sum(receipts * abs(mean_confidence - accuracy)) / sum(receipts), 4) AS expected_calibration_error FROM c")
def expected_calibration_error(spark, sf_dir):
    return evaluation.calibration_error(fields(spark, sf_dir), "pred_confidence", "required_fields_all_correct")


def truth_items(spark, sf_dir):
    return view(spark, sf_dir, ITEMS)


def pred_items(spark, sf_dir):
    return view(spark, sf_dir, PRED_ITEMS)


PAIRS = f"""WITH truth AS ({oracle(ITEMS)}), pred AS ({oracle(PRED_ITEMS)}),
x AS (SELECT p.receipt_id, p.pos AS pred_pos, t.pos AS truth_pos, 1 - levenshtein(p.name, t.name) / greatest(length(p.name), length(t.name)) AS s FROM pred p JOIN truth t ON p.receipt_id = t.receipt_id AND abs(p.price - t.price) <= 0.01),
pairs AS (SELECT receipt_id, pred_pos, truth_pos, round(s, 6) AS similarity FROM x WHERE s >= 0.8) """


@query(PAIRS + "SELECT * FROM pairs")
def item_candidate_pairs(spark, sf_dir):
    return matching.candidate_pairs(pred_items(spark, sf_dir), truth_items(spark, sf_dir))


#: Items of which several claim the same one: names of 20 characters, each edit worth 0.05. The optimum takes two weaker pairs
#: (key % 3 = 0), the stronger of two pairings (1), or the better of two single pairs (2); the greedy order differs in the first two.
_BASE = "lpad(CAST(p_partkey AS STRING), 20, 'x')"
CONTESTED_TRUTH = f"SELECT p_partkey AS receipt_id, 0 AS pos, 'yzz' || substr({_BASE}, 4) AS name, 1.0 AS price FROM {{part}} UNION ALL SELECT p_partkey, 1, {_BASE}, 1.0 FROM {{part}}"
CONTESTED_PRED = f"""SELECT p_partkey AS receipt_id, 0 AS pos, 'y' || substr({_BASE}, 2) AS name, 1.0 AS price FROM {{part}}
UNION ALL SELECT p_partkey, 1, CASE p_partkey % 3 WHEN 0 THEN 'xxxqq' || substr({_BASE}, 6) WHEN 1 THEN 'xxxq' || substr({_BASE}, 5) ELSE 'another thing' END, 1.0 FROM {{part}}"""
#: All four possible pairs of a receipt side by side; of two by two items only two assignments are whole.
CONTESTED = f"""WITH t AS ({oracle(CONTESTED_TRUTH)}), p AS ({oracle(CONTESTED_PRED)}),
x AS (SELECT p.receipt_id, p.pos AS i, t.pos AS j, round(1 - levenshtein(p.name, t.name) / greatest(length(p.name), length(t.name)), 6) AS s FROM p JOIN t ON p.receipt_id = t.receipt_id),
k AS (SELECT *, row_number() OVER (PARTITION BY receipt_id ORDER BY s DESC, i, j) AS place, coalesce(sum(s + 0.01) OVER (PARTITION BY receipt_id, i = j), 0) AS own, coalesce(sum(s + 0.01) OVER (PARTITION BY receipt_id), 0) AS every FROM x WHERE s >= 0.8) """


def contested(spark, sf_dir, method):
    pairs = matching.candidate_pairs(view(spark, sf_dir, CONTESTED_PRED), view(spark, sf_dir, CONTESTED_TRUTH))
    return matching.matches(pairs, method=method).select("receipt_id", "pred_pos", "truth_pos")


@query(CONTESTED + "SELECT receipt_id, i AS pred_pos, j AS truth_pos FROM k WHERE own > every - own")
def item_assignment_optimal(spark, sf_dir):
    return contested(spark, sf_dir, "optimal")


@query(CONTESTED + "SELECT k.receipt_id, k.i AS pred_pos, k.j AS truth_pos FROM k JOIN k f ON k.receipt_id = f.receipt_id AND f.place = 1 WHERE k.place = 1 OR (k.i <> f.i AND k.j <> f.j)")
def item_assignment_greedy(spark, sf_dir):
    return contested(spark, sf_dir, "greedy")


#: With at most one candidate per item the pairs are the matches; where an item has more, greedy and optimal agree on counts here.
COUNTS = PAIRS + """, m AS (SELECT receipt_id, least(count(DISTINCT pred_pos), count(DISTINCT truth_pos)) AS m FROM pairs GROUP BY 1), pc AS (SELECT receipt_id, count(*) AS p FROM pred GROUP BY 1), tc AS (SELECT receipt_id, count(*) AS t FROM truth GROUP BY 1),
c AS (SELECT coalesce(pc.receipt_id, tc.receipt_id) AS receipt_id, coalesce(m, 0) AS tp, coalesce(p, 0) - coalesce(m, 0) AS fp, coalesce(t, 0) - coalesce(m, 0) AS fn FROM pc FULL OUTER JOIN tc ON pc.receipt_id = tc.receipt_id LEFT JOIN m ON m.receipt_id = coalesce(pc.receipt_id, tc.receipt_id)),
q AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS re FROM c),
w AS (SELECT *, CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS f FROM q),
s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, avg(round(pr, 6)) AS mp, avg(round(re, 6)) AS mr, avg(round(f, 6)) AS mf FROM w),
f1 AS (SELECT *, tp / (tp + fp) AS up, tp / (tp + fn) AS ur FROM s) """


@query(COUNTS + "SELECT receipt_id, tp, fp, fn FROM c")
def item_match_counts(spark, sf_dir):
    p, t = pred_items(spark, sf_dir), truth_items(spark, sf_dir)
    return evaluation.item_counts(p, t, matching.matches(matching.candidate_pairs(p, t)))


@query(COUNTS + "SELECT tp, fp, fn, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(up, 6) AS micro_precision, round(ur, 6) AS micro_recall, round(2 * up * ur / (up + ur), 6) AS micro_f1 FROM f1")
def item_micro_macro_f1(spark, sf_dir):
    return evaluation.micro_macro(item_match_counts(spark, sf_dir))


@query(COUNTS + """, v AS (UNPIVOT (SELECT round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1 FROM w) ON precision, recall, f1 INTO NAME metric VALUE value)
SELECT metric, count(value) AS receipts, round(avg(value), 6) AS mean, round(median(value), 6) AS median FROM v GROUP BY metric""")
def item_metrics_per_receipt(spark, sf_dir):
    counts = item_match_counts(spark, sf_dir)
    return evaluation.receipt_means(counts.withColumns(evaluation.rates(F.col("tp"), F.col("fp"), F.col("fn"))), ["precision", "recall", "f1"])


GATES = ALIGNED + f""",
g AS (SELECT (SELECT sum(distance) / greatest(1, sum(length)) FROM ({CER})) AS corpus_cer, (SELECT sum(distance) / greatest(1, sum(words)) FROM ({WER})) AS corpus_wer,
""" + """  count(*) FILTER (store_correct) / count(store_correct) AS store_accuracy, count(*) FILTER (date_correct) / count(date_correct) AS date_accuracy, count(*) FILTER (total_correct) / count(total_correct) AS total_accuracy, CAST(NULL AS DOUBLE) AS item_f1 FROM e),
h AS (SELECT unnest([{'gate': 'corpus_cer', 'value': corpus_cer, 'threshold': 0.20, 'up': false}, {'gate': 'corpus_wer', 'value': corpus_wer, 'threshold': 0.30, 'up': false}, {'gate': 'store_accuracy', 'value': store_accuracy, 'threshold': 0.90, 'up': true},
  {'gate': 'date_accuracy', 'value': date_accuracy, 'threshold': 0.90, 'up': true}, {'gate': 'total_accuracy', 'value': total_accuracy, 'threshold': 0.95, 'up': true}, {'gate': 'item_f1', 'value': item_f1, 'threshold': 0.85, 'up': true}]) AS x FROM g),
k AS (SELECT x.gate AS gate, round(x.value, 6) AS value, CAST(x.threshold AS DOUBLE) AS threshold, CASE WHEN x.value IS NULL THEN 'not_evaluable' WHEN (x.up AND x.value >= x.threshold) OR (NOT x.up AND x.value <= x.threshold) THEN 'passed' ELSE 'failed' END AS status FROM h)
SELECT * FROM k UNION ALL SELECT 'overall', NULL, NULL, CASE WHEN count(*) FILTER (status = 'failed') > 0 THEN 'failed' WHEN count(*) FILTER (status = 'passed') > 0 THEN 'passed' ELSE 'not_evaluable' END FROM k"""


@query(GATES)
def quality_gates(spark, sf_dir):
    acc = evaluation.accuracy(fields(spark, sf_dir), {"store": "store_correct", "date": "date_correct", "total": "total_correct"})
    wide = acc.agg(*(F.max(F.when(F.col("field") == f, F.col("accuracy"))).alias(f"{f}_accuracy") for f in ("store", "date", "total")))
    metrics = wide.crossJoin(corpus_cer(spark, sf_dir).select("corpus_cer")).crossJoin(corpus_wer(spark, sf_dir).select("corpus_wer")).withColumn("item_f1", F.lit(None).cast("double"))
    return evaluation.gates(metrics)


@query("""SELECT o_orderstatus AS stage, count(*) AS total, count(*) FILTER (o_orderpriority <> '1-URGENT') AS successful, round(count(*) FILTER (o_orderpriority <> '1-URGENT') / count(*), 6) AS success_rate,
  round(avg(o_totalprice) FILTER (o_orderpriority <> '1-URGENT'), 2) AS mean_value FROM orders GROUP BY 1""")
def stage_manifest_rates(spark, sf_dir):
    return tracking.manifest(table(spark, sf_dir, "orders"), "o_orderstatus", F.col("o_orderpriority") != "1-URGENT", "o_totalprice")
