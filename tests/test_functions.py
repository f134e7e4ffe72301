"""Scalar functions and their quirks, by hand-written cases."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.functions import values as V
from tallyforge.operators import cleaning, extraction, scoring


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("value", "want"),
    [("T0TAL", "TOTAL"), ("TOTAI", "TOTAL"), ("GRAND  T0TAL", "GRAND TOTAL"), ("am0unt payable", "AMOUNT PAYABLE"), ("T0TAL 5", "TOTAL 5"), ("T0TALS", "T0TALS"), ("RECElPT", "RECEIPT"), ("", "")],
)
def test_corrections(spark, value, want):
    assert one(spark, value, T.correct_errors) == want


@pytest.mark.parametrize(("value", "want"), [("Rs. 120", "120"), ("₹50", "50"), ("INR 7", "7"), ("pay INR", "pay "), ("RS 5", "5"), ("cars 120", "ca120")])
def test_currency(spark, value, want):
    assert one(spark, value, T.strip_currency) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [("5/1/24", "2024-01-05"), ("31-02-2024", "2024-02-31"), ("45/13/2024", "45/13/2024"), ("2024/1/5", "2024-01-05"), ("a 1.2.2023 b 2023-3-4", "a 2023-02-01 b 2023-03-04"), ("none", "none")],
)
def test_date_normalize(spark, value, want):
    assert one(spark, value, V.normalize_dates) == want


@pytest.mark.parametrize(
    ("value", "order", "want"),
    [("05/06/2024", "DMY", "2024-06-05"), ("05/06/2024", "MDY", "2024-05-06"), ("05/06/2024", "YMD", None), ("2024.6.5", "YMD", "2024-06-05"), ("31/02/2024", "DMY", None), ("5/6/24", "DMY", "2024-06-05"), ("x", "DMY", None), (None, "DMY", None)],
)
def test_date_order(spark, value, order, want):
    assert one(spark, value, lambda c: V.date_in_order(c, order)) == want


@pytest.mark.parametrize(
    ("value", "up", "even"),
    [("Rs 1,200.50", 1200.50, 1200.50), ("(50)", None, None), ("-3", None, -3.0), ("2.665", 2.67, 2.66), ("2.675", 2.68, 2.68), ("", None, None), ("NaN", None, None), (None, None, None)],
)
def test_money(spark, value, up, even):
    got, got_even = one(spark, value, V.money_half_up), one(spark, value, V.money_half_even)
    assert (None if got is None else float(got)) == up
    assert (None if got_even is None else float(got_even)) == even


@pytest.mark.parametrize(("value", "want"), [("yes", True), (" TRUE ", True), ("1", True), ("No", False), ("2", False), ("", False), (None, False)])
def test_bool(spark, value, want):
    assert one(spark, value, V.to_bool) is want


@pytest.mark.parametrize(("value", "want"), [("NaN", None), ("Infinity", None), ("1e3", 1000.0), ("x", None), (None, None)])
def test_safe_float(spark, value, want):
    assert one(spark, value, V.safe_float) == want


@pytest.mark.parametrize(("value", "want"), [("TEA 2x10.00", [2.0, 0.0]), ("12:30", []), ("12.345", [12.0, 345.0]), ("Rs. 1,250.50 and 7", [1250.5, 7.0]), ("at 12:30 5", [5.0])])
def test_amounts(spark, value, want):
    assert one(spark, value, V.amounts) == want


@pytest.mark.parametrize(("value", "want"), [("  Foo-Mart  ", "FOO MART"), ("FOO MART", "FOO MART"), ("***", T.UNKNOWN_STORE), (None, T.UNKNOWN_STORE)])
def test_store(spark, value, want):
    assert one(spark, value, T.canonical_store) == want


def test_nfkc(spark):
    assert one(spark, "１２ﬁ", T.nfkc) == "12fi"
    assert one(spark, None, T.nfkc) is None


def test_control_characters(spark):
    assert one(spark, "a​b\x00\tc\n", T.drop_controls) == "ab\tc\n"


def test_word_distance(spark):
    row = spark.createDataFrame([("the cat sat", "the bat sat down")], "a string, b string").select(T.word_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert row["d"] == 2


def test_word_distance_over_many_words(spark):
    """More distinct words than the basic plane holds; the distance is still exact."""
    a = [f"w{i}" for i in range(40_000)]
    b = a[:100] + ["new", *a[101:5000], *a[5003:]]
    df = spark.createDataFrame([(" ".join(a[:36_000]), " ".join(b[:35_997])), (" ".join(f"x{i}" for i in range(37_000)), "")], "a string, b string")
    got = df.select(T.word_distance(F.substring_index("a", " ", 50), F.substring_index("b", " ", 52)).alias("d"), T.words(F.col("a")).alias("w")).first()
    assert got["d"] == 2 and len(got["w"]) == 36_000
    tail = spark.createDataFrame([(" ".join(a[:38_000]), "zz w1 w37999")], "a string, b string").select(T.word_distance(F.col("a"), F.col("b")).alias("d")).first()
    assert tail["d"] == 38_000 - 2


def test_word_distance_by_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(" ".join(rng.choices("a b c d é 日".split(), k=rng.randint(0, 9))), " ".join(rng.choices("a b c d é 日".split(), k=rng.randint(0, 9)))) for _ in range(60)]

    def brute(x, y):
        d = list(range(len(y) + 1))
        for i, p in enumerate(x, 1):
            last, d[0] = d[0], i
            for j, q in enumerate(y, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (p != q))
        return d[-1]

    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", T.word_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r["d"] == brute(r["a"].split(), r["b"].split()) for r in got)


def test_casefold_everywhere(spark):
    """Every code point but surrogates, and words where lower case depends on neighbours."""
    texts = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000] + ["Straße", "STRASSE", "ΣΑΣ", "ΑΣ Σ", "İstanbul", "ﬁn", "ẞ", "ᏸᎠ", "ǰ", "Plain TEXT"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.casefold(F.col("t")).alias("f")).collect()
    wrong = [(texts[r["i"]], r["f"]) for r in rows if r["f"] != texts[r["i"]].casefold()]
    assert len(wrong) <= 60 and all(len(t) == 1 for t, _ in wrong), wrong[:20]  # letters newer than the JVM's Unicode version
    assert one(spark, None, T.casefold) is None


def test_evaluation_compares_folded_text(spark):
    from tallyforge.operators import evaluation

    df = spark.createDataFrame([("Straße  Markt", "STRASSE MARKT"), ("Café, bar!", "café bar"), (None, "x"), ("", "")], "a string, b string")
    got = df.select(evaluation.strings_match(F.col("a"), F.col("b")).alias("m"), T.evaluation_text(F.col("a"), punctuation=True).alias("p")).collect()
    assert [r["m"] for r in got] == [True, False, False, True]
    assert [r["p"] for r in got] == ["strasse markt", "café bar", None, ""]


def test_similarity_of_names(spark):
    df = spark.createDataFrame([("", ""), ("a", ""), ("milk", "milk"), ("milk", "mild"), ("abcdefghij", "abcdefghxy"), ("abcdefghij", "abcdefgxyz")], "a string, b string")
    got = df.select(T.similarity(F.col("a"), F.col("b")).alias("s"), T.similarity(F.col("a"), F.col("b"), 0.8).alias("t")).collect()
    assert [round(r["s"], 6) for r in got] == [0.0, 0.0, 1.0, 0.75, 0.8, 0.7]
    assert [round(r["t"], 6) for r in got] == [0.0, 0.0, 1.0, 0.0, 0.8, 0.0]


def test_redact(spark):
    assert one(spark, "https://u:p@h.io/x?token=abc&y=1 Bearer abc.def api-key = zz", T.redact) == "https://***:***@h.io/x?token=***&y=1 Bearer *** api-key=***"


def test_clean_text_is_idempotent_and_logs(spark):
    df = spark.createDataFrame([("Shop\nT0TAL: 12\n-----\nMilk 40\nMilk 40!!!!\n",), ("",), (None,)], "t string")
    once = cleaning.clean_text(df, "t", unicode=True)
    rows = once.collect()
    assert rows[0]["cleaned"] == "Shop\nTOTAL: 12\nMilk 40\nMilk 40!"
    assert rows[0]["changes"] == ["whitespace_normalization", "common_ocr_correction", "punctuation_normalization", "noise_line_removal"]
    assert rows[1]["cleaned"] == "" and rows[2]["cleaned"] is None
    again = cleaning.clean_text(once.select(F.col("cleaned").alias("t")), "t").collect()
    assert again[0]["changes"] == []


def extracted(spark, lines):
    df = spark.createDataFrame([(lines,)], "lines array<string>")
    return extraction.extract(df).first()


def test_extraction(spark):
    r = extracted(spark, ["STORE: Corner Shop", "DATE 05/01/2024", "TEA 2x10.00", "COFFEE 3.50", "coffee 3.5", "SUBTOTAL 10.00", "GRAND TOTAL", "23.50"])
    assert (r["vendor_name"], r["transaction_date"], r["total_amount"]) == ("Corner Shop", "2024-01-05", 23.5)
    assert r["total_candidate"]["extraction_method"] == "total_keyword_next_line"
    assert [(i["name"], i["price"]) for i in r["items"]] == [("TEA", 10.0), ("COFFEE", 3.5)]
    assert r["status"] == "success"


def test_extraction_quirks(spark):
    # a payment line without the word TOTAL is no total; price-first lines look like addresses
    r = extracted(spark, ["Shop", "BALANCE DUE 10.00", "3.50 COFFEE"])
    assert r["total_amount"] == 3.5 and r["total_candidate"]["confidence"] == 0.60
    assert r["items"] == []
    assert extracted(spark, [])["status"] == "failed"
    assert extracted(spark, None)["status"] == "failed"
    assert extracted(spark, ["# ITEMS SOLD 3"])["expected_item_count"] == 3


def test_scoring(spark):
    df = extraction.extract(spark.createDataFrame([(["STORE: Corner Shop", "DATE 05/01/2024", "TEA 2x10.00", "TOTAL 10.00", "ITEMS SOLD 3"],)], "lines array<string>"))
    df = df.withColumn("regions", F.transform("lines", lambda t: F.struct(t.alias("cleaned_text"), F.lit(0.9).alias("confidence"))))
    r = scoring.score(df).first()
    assert r["conflicts"] == ["item_count_mismatch"] and r["review_required"]
    assert r["fields"]["store_name"]["evidence"] == "indexed_exact_source"
    assert 0 < r["overall_confidence"] < 0.7


def test_arrow_functions(spark):
    from tallyforge.config import Evaluation
    from tallyforge.functions import arrow
    from tallyforge.operators import evaluation

    df = spark.createDataFrame([("abcd", "bcde", 2.675, "Straße", '{"a": [{"api-key": "x", "n": NaN}], "b": 1}'), (None, "x", None, None, "broken")], "a string, b string, x double, s string, j string")
    rows = df.select(arrow.sequence_ratio(F.col("a"), F.col("b")).alias("r"), arrow.py_round(F.col("x"), 2).alias("x"), T.casefold(F.col("s")).alias("s"), arrow.redact_json(F.col("j")).alias("j")).collect()
    assert (rows[0]["r"], rows[0]["x"], rows[0]["s"]) == (0.75, 2.67, "strasse")
    assert rows[0]["j"] == '{"a": [{"api-key": "***", "n": null}], "b": 1}'
    assert rows[1]["s"] is None and rows[1]["j"] is None
    loose = Evaluation(strict_strings=False, string_threshold=0.7)
    got = df.select(evaluation.strings_match(F.col("a"), F.col("b"), loose).alias("m")).collect()
    assert [r["m"] for r in got] == [True, False]


def test_config():
    from tallyforge import config

    made = config.load(config.Extraction, {"vendor_lines": 3, "total_keywords": ["TOTAL"], "other": 1})
    assert made.vendor_lines == 3 and made.total_keywords == ("TOTAL",)
    with pytest.raises(ValueError):
        config.Confidence(ocr_weight=0.9)
    with pytest.raises(ValueError):
        config.Evaluation(date_order="XYZ")


@pytest.mark.parametrize("value, want", [("29/02/2024", "2024-02-29"), ("29/02/2023", None), ("29-2-1900", None), ("29.2.2000", "2000-02-29"), ("31/04/2024", None), ("00/01/2024", None), ("1/13/24", None), ("1/1/24", "2024-01-01"), ("1/1/123", None), ("31/02/2024 2024-3-5", "2024-03-05"), ("none", None)])
def test_first_date(spark, value, want):
    assert one(spark, value, V.first_date) == want


def test_vetoes_hold_over_runs_of_blanks(spark):
    r = extracted(spark, ["12 34 Corner Shop", "STORE", "THANK  YOU 3.50", "PAY   FROM 4.00", "THE ITEM @ 2.00", "BAG # 12 1.00", "TEA 50 % 2.00", "OAK STREET 1.00", "MILK 2.00", "AMT 7.25"])
    assert [x["name"] for x in r["items"]] == ["MILK", "AMT"] and r["vendor_name"] is not None
    assert (r["total_amount"], r["total_candidate"]["region_index"]) == (7.25, 9)
