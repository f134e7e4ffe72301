"""Confidence and reliability of extracted fields and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.config import Confidence
from tallyforge.functions import text as T
from tallyforge.functions import values as V
from tallyforge.functions.values import let


def combine(ocr: Column, extraction: Column, pattern: Column, context: Column, conflict: Column, penalty: Column | None = None, config: Confidence = Confidence()) -> Column:
    """Weighted score, lowered on conflict and by the extra penalty, clipped and rounded."""
    score = config.ocr_weight * V.clip(ocr) + config.pattern_weight * V.clip(0.7 * pattern + 0.3 * extraction) + config.context_weight * V.clip(context)
    score = F.when(conflict, score * (1 - config.conflict_penalty)).otherwise(score)
    return F.round(V.clip(score * (1 - F.coalesce(penalty, F.lit(0.0)) if penalty is not None else score)), config.digits)


def review(conf: Column, conflict: Column, config: Confidence = Confidence()) -> Column:
    return (conf < config.low) | F.coalesce(conflict, F.lit(False))


def vendor_pattern(c: Column) -> Column:
    return F.when(c.isNull(), 0.0).when((T.letters(c) >= 2) & (T.letters(c) >= T.digits(c)), 1.0).otherwise(0.4)


def date_pattern(c: Column) -> Column:
    return F.when(c.isNull(), 0.0).when(~c.rlike(V.ISO), 0.3).when(F.try_to_date(c, "yyyy-MM-dd").isNull(), 0.1).otherwise(1.0)


def amount_pattern(c: Column) -> Column:
    return F.when(c.isNull(), 0.0).when(c < 0, 0.1).otherwise(1.0)


def item_pattern(name: Column, price: Column) -> Column:
    named = F.when(name.isNull() | (F.trim(name) == ""), 0.0).when(T.letters(name) >= 2, 1.0).otherwise(0.3)
    return 0.5 * named + 0.5 * F.when(price.isNull(), 0.0).when(price < 0, 0.2).otherwise(1.0)


def vendor_context(method: Column, at: Column) -> Column:
    return F.when(method == "vendor_label", 1.0).when((method == "top_line_heuristic") & (at == 0), 0.95).when(method == "top_line_heuristic", 0.8).otherwise(0.6)


def date_context(method: Column) -> Column:
    return F.when(method == "date_label_regex", 1.0).when(method == "date_regex", 0.9).otherwise(0.6)


def total_context(method: Column) -> Column:
    return F.when(method == "total_keyword_amount", 1.0).when(method == "total_keyword_next_line", 0.9).when(method == "last_lines_amount_fallback", 0.55).otherwise(0.6)


def count_consistency(found: Column, expected: Column) -> Column:
    """Struct of score and conflict: unknown .5, equal 1, off by one .55, else .2."""
    gap = F.abs(found - expected)
    score = F.when(expected.isNull(), 0.5).when(gap == 0, 1.0).when(gap == 1, 0.55).otherwise(0.2)
    return F.struct(score.alias("score"), F.coalesce(gap > 0, F.lit(False)).alias("conflict"))


def financial_consistency(item_sum: Column, total: Column, config: Confidence = Confidence()) -> Column:
    """Struct of the difference, its share of the total, and the verdict of the item sum against the total."""
    gap = F.abs(item_sum - total)
    share = F.when(total > 0, gap / total)
    verdict = (
        F.when(item_sum.isNull() | total.isNull(), "not_evaluable")
        .when((gap <= config.absolute_tolerance) | (share <= config.relative_tolerance), "consistent")
        .when(share <= 0.15, "close")
        .otherwise("mismatch")
    )
    return F.struct(F.round(gap, 4).alias("difference"), F.round(share, 4).alias("relative_difference"), verdict.alias("verdict"))


def with_sources(df: DataFrame, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Left joins to one row per key of each source; the name of a source tells whether it had one."""
    for has, (source, key) in sources.items():
        df = df.join(source.withColumn(has, F.lit(True)), key, "left").withColumn(has, F.coalesce(has, F.lit(False)))
    return df


def best_region(regions: Column, value: Column, source: Column, index: Column) -> Column:
    """Region that supports a value: at its index, else anywhere, by source text, by value, then by containment.

    Struct of ``confidence`` and ``method``. Without any match the mean confidence counts for 0.6. Texts
    that are equal as they stand need no normal form, and the other regions are read only if the one at
    the index does not support the value.
    """
    norm = lambda t: let(T.squeeze(t), T.casefold)
    here = F.get(regions, index)
    made = lambda conf, name: F.struct(conf.cast("double").alias("confidence"), F.lit(name).alias("method"))
    mean = F.aggregate(regions, F.lit(0.0), lambda a, r: a + r["confidence"]) / F.size(regions)
    neither = F.when(F.size(regions) > 0, made(0.6 * mean, "receipt_level_fallback")).otherwise(made(F.lit(0.0), "ocr_evidence_unavailable"))

    def compared(ts: Column) -> Column:
        s, v, at = ts[0], ts[1], ts[2]
        part = lambda t: t.contains(v) | v.contains(t)

        def anywhere(texts: Column) -> Column:
            def first(test, name: str, rest: Column) -> Column:
                found = F.get(F.filter(regions, lambda r, i: test(F.get(texts, i))), F.lit(0))["confidence"]
                return let(found, lambda c: F.when(c.isNotNull(), made(c, name)).otherwise(rest))

            return first(lambda t: t == s, "global_exact_source", first(lambda t: t == v, "global_exact_value", first(part, "global_partial_match", neither)))

        return (
            F.when(at == s, made(here["confidence"], "indexed_exact_source"))
            .when(at == v, made(here["confidence"], "indexed_exact_value"))
            .when(part(at), made(here["confidence"], "indexed_partial_match"))
            .when(s.isNull() & v.isNull(), neither)
            .otherwise(let(F.transform(regions, lambda r: norm(r["cleaned_text"])), anywhere))
        )

    texts = F.transform(F.array(source, value.cast("string"), here["cleaned_text"]), norm)
    return F.when(here["cleaned_text"] == source, made(here["confidence"], "indexed_exact_source")).otherwise(let(texts, compared))


def score(df: DataFrame, config: Confidence = Confidence()) -> DataFrame:
    """Scores extraction results that carry ``regions`` (cleaned_text, confidence); without regions evidence is unavailable.

    Adds ``fields`` (store_name, date, total_amount), scored ``items``, ``overall_confidence``,
    ``reliability``, ``review_required`` and ``conflicts``.
    """
    known = F.transform("regions", lambda r: F.struct(r["cleaned_text"].alias("cleaned_text"), r["confidence"].cast("double").alias("confidence")))
    df = df.withColumn("__regions", F.coalesce(known, F.array().cast("array<struct<cleaned_text:string,confidence:double>>")))
    regions = F.col("__regions")
    df = df.withColumn("__count", count_consistency(F.col("item_count"), F.col("expected_item_count")))
    item_sum = F.when(F.size("items") > 0, F.aggregate("items", F.lit(0.0), lambda a, x: a + x["price"]))
    df = df.withColumn("financial_consistency", financial_consistency(item_sum, F.col("total_amount"), config))
    mismatch = F.col("financial_consistency.verdict") == "mismatch"
    specs = {
        "store_name": ("vendor_name", "vendor_candidate", vendor_pattern, vendor_context(F.col("vendor_candidate.extraction_method"), F.col("vendor_candidate.region_index")), F.lit(False), F.lit(0.0)),
        "date": ("transaction_date", "date_candidate", date_pattern, date_context(F.col("date_candidate.extraction_method")), F.lit(False), F.lit(0.0)),
        "total_amount": ("total_amount", "total_candidate", amount_pattern, total_context(F.col("total_candidate.extraction_method")), mismatch, F.when(F.col("__count.conflict"), config.total_count_penalty).otherwise(0.0)),
    }
    made = []
    for name, (value, cand, pattern, context, conflict, penalty) in specs.items():
        v = F.col(value)
        region = best_region(regions, v, F.col(f"{cand}.source_text"), F.col(f"{cand}.region_index"))
        df = df.withColumn(f"__{name}", region)
        conf = F.when(v.isNull(), 0.0).otherwise(combine(F.col(f"__{name}.confidence"), F.coalesce(F.col(f"{cand}.confidence"), F.lit(0.0)), pattern(v), context, conflict, penalty, config))
        df = df.withColumn(f"__{name}_conf", conf)
        c = F.col(f"__{name}_conf")
        made.append(F.struct(v.cast("string").alias("value"), c.alias("confidence"), V.tier(c, config.medium, config.low).alias("reliability"), review(c, conflict, config).alias("review_required"),
                             F.col(f"__{name}.confidence").alias("ocr_confidence"), pattern(v).alias("pattern_confidence"), context.alias("context_confidence"), F.col(f"__{name}.method").alias("evidence"), conflict.alias("conflict_detected")).alias(name))

    def item(x: Column) -> Column:
        region = best_region(regions, x["name"], x["source_text"], x["region_index"])
        context = 0.7 * F.when(x["extraction_method"].isin("quantity_price_regex", "name_price_regex"), 0.85).otherwise(0.55) + 0.3 * F.col("__count.score")
        score = combine(region["confidence"], x["confidence"], item_pattern(x["name"], x["price"]), context, F.lit(False), None, config)
        return let(score, lambda c: F.struct(x["name"].alias("name"), x["price"].alias("price"), c.alias("confidence"), V.tier(c, config.medium, config.low).alias("reliability"), review(c, F.lit(False), config).alias("review_required"), x["source_text"].alias("source_text"), x["region_index"].alias("region_index")))

    df = df.withColumn("fields", F.struct(*made)).withColumn("items", F.transform("items", item))
    conflicts = V.codes((F.col("__count.conflict"), "item_count_mismatch"), (mismatch, "item_sum_total_mismatch"))
    fields = (F.col("__store_name_conf") + F.col("__date_conf") + F.col("__total_amount_conf")) / 3
    mean_items = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size("items")
    overall = F.when(F.size("items") > 0, 0.75 * fields + 0.25 * mean_items).otherwise(fields)
    overall = F.when(F.col("__count.conflict"), overall * (1 - config.count_penalty)).otherwise(overall)
    overall = F.when(F.size(conflicts) > 0, overall * (1 - config.conflict_penalty)).otherwise(overall)
    df = df.withColumn("conflicts", conflicts).withColumn("overall_confidence", F.round(V.clip(overall), config.digits))
    any_field = F.col("fields.store_name.review_required") | F.col("fields.date.review_required") | F.col("fields.total_amount.review_required")
    df = df.withColumns({
        "reliability": V.tier(F.col("overall_confidence"), config.medium, config.low),
        "review_required": (F.col("overall_confidence") < config.low) | (F.size("conflicts") > 0) | any_field | F.exists("items", lambda x: x["review_required"]),
    })
    return df.drop(*[c for c in df.columns if c.startswith("__")])
