"""Quality rules by distribution divergence.

One pass takes the base counts of each text and two histograms: of character classes, digits
among them, and of common words, other words and numbers. The histograms of documents that pass the base rules are summed by language over the whole
corpus; these sums are the language references. A document is kept if, for some language, the
Jensen-Shannon distances of its histograms to the references are within the thresholds. Texts with
too few characters or common words for a stable histogram skip that comparison.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_map, fresh, release, written

#: Base rules: least words, greatest percentage of repeated words.
LEAST_WORDS, REPEATED = 50, 50
#: Thresholds of the divergences (base 2, square root), the first fitted to the labels of sf0.01, and the least characters and common words to compare.
CHARACTERS, WORDS = 0.18, 0.45
LEAST_CHARACTERS, LEAST_COMMON = 200, 30
#: Words a language needs in all its documents to serve as a reference.
LEAST_REFERENCE = 2000
#: A document adds to a reference if it has a symbol per so many words at most.
REFERENCE_SYMBOLS = 20
SYMBOLS = "#*$%&|<>"

#: Common function words, in natural order by language.
COMMON = """
the of and to in that is was for on are with as be at by this from or it not have
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als
de la que el en y a los del se las por un para con no una su al lo
le les des et une du dans est pour qui au par sur pas plus ce avec son il sont
""".split()
WORD_AT = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON))}
#: A numeric token, the last bin of the word histogram.
NUMBER = re.compile(r"\d+")
CLASSES = ("lower", "upper", "other letter", "digit", "space", "line end", "stop", "symbol", "other")


def class_table() -> np.ndarray:
    """Class of each code point below 0x10000 (anything above: other)."""
    table = np.full(0x10000, 8, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        table[c] = 5 if x in "\n\r" else 4 if x.isspace() else 3 if x.isdigit() else 0 if x.islower() else 1 if x.isupper() else 2 if x.isalpha() else 7 if x in SYMBOLS else 6 if c < 128 else 8
    table[0x3040:0xA000] = 2
    table[0xAC00:0xD7A4] = 2
    return table


CLASS = class_table()
#: ASCII bytes other than letters become spaces, capitals small; bytes of other characters stay.
CLEAN = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == n:
        return 0
    count = Counter(windows)
    total, end = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def measure(text: str) -> tuple[list[int], np.ndarray]:
    """Base counts (words, their characters, symbols, repeated lines, repeated words) and both histograms."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    base = [
        len(words),
        len(b"".join(words).decode()) if len(raw) != len(text) else sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    ]
    hist = np.zeros(len(CLASSES) + len(WORD_AT) + 2, np.uint32)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    hist[: len(CLASSES)] = np.bincount(CLASS[np.minimum(code, 0xFFFF)], minlength=len(CLASSES))
    plain = raw.lower().translate(CLEAN) if text.isascii() else text.lower().encode().translate(CLEAN)
    seen = Counter(plain.split())
    common = 0
    for w, i in WORD_AT.items():
        if w in seen:
            hist[len(CLASSES) + i] = seen[w]
            common += seen[w]
    hist[-2] = seen.total() - common
    hist[-1] = len(NUMBER.findall(text))
    return base, hist


def features(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang") -> DataFrame:
    """``key, lang``, base counts, ``base_failed`` and ``hist`` (binary uint32) of every text; null: no words."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def make():
        release()

        def step(keys, langs, texts):
            made = [measure(t or "") for t in texts]
            out = {n: [b[i] for b, _ in made] for i, n in enumerate(names)}
            failed = [base_fails(b) for b, _ in made]
            return out | {"key": keys, "lang": langs, "base_failed": failed, "hist": [h.tobytes() for _, h in made]}

        return step

    return arrow_map(docs.select(F.col(key).alias("key"), F.col(label).alias("lang"), F.col(text).alias("text")),
                     "key bigint, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, hist binary", make)


def references(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their summed histograms, a row each, of documents that pass the base rules. The driver gets a row per language."""
    size = len(CLASSES) + len(WORD_AT) + 2

    def make():
        def step(langs, hists):
            total: dict[str, np.ndarray] = {}
            for lang, h in zip(langs, hists):
                total[lang] = total.get(lang, 0) + np.frombuffer(h, np.uint32).astype(np.int64)
            return {"lang": list(total), "sums": [v.tolist() for v in total.values()]}

        return step

    plain = F.col("n_symbols") * REFERENCE_SYMBOLS <= F.col("n_words")
    parts = arrow_map(rows.where(plain & F.expr("not base_failed and lang is not null")).select("lang", "hist"), "lang string, sums array<bigint>", make)
    summed = parts.groupBy("lang").agg(*(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)))
    out = [list(r) for r in summed.orderBy("lang").toLocalIterator()]
    out = [r for r in out if sum(r[1 + len(CLASSES) :]) >= LEAST_REFERENCE]
    return [r[0] for r in out], np.array([r[1:] for r in out], float).reshape(-1, size)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts ``p`` to each row of ``q``, in 0..1."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1e-12)
    q = q / np.maximum(q.sum(1, keepdims=True), 1e-12)
    m = (p[:, None] + q[None]) / 2

    def part(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(2)

    return np.sqrt(np.clip((part(p[:, None]) + part(q[None])) / 2, 0, 1))


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang") -> DataFrame:
    """Base counts, both divergences (to the nearest language), ``base_failed`` and ``kept`` per row.

    Null text: no words, so the base rules fail it. Rows without a language are judged like others
    but add to no reference; a language without a reference, for it has too few words, is left to the
    base rules. Equal divergences: the first language by name. Repeated rows come out repeated; texts
    of any length; other columns are ignored, whatever their names. Empty table: no rows.
    """
    rows = written(features(docs, text, key, label), "quality")
    refs = references(rows)

    def make():
        return lambda langs, failed, hists: verdicts(langs, failed, hists, *refs)

    return judged(rows, make).withColumnRenamed("key", key)


def verdicts(langs: list[str | None], failed: list[bool], hists: list[bytes], names: list[str], refs: np.ndarray) -> dict[str, list]:
    """Divergences from the nearest reference, and whether each row is kept; 0 where the row's language has no reference."""
    if not len(refs) or not hists:
        return {"char_divergence": [0.0] * len(failed), "word_divergence": [0.0] * len(failed), "kept": [not f for f in failed]}
    h = np.frombuffer(b"".join(hists), np.uint32).reshape(len(hists), -1).astype(float)
    k = len(CLASSES)
    chars, words = distance(h[:, :k], refs[:, :k]), distance(h[:, k:], refs[:, k:])
    chars[h[:, :k].sum(1) < LEAST_CHARACTERS] = 0
    words[h[:, k:].sum(1) < LEAST_COMMON] = 0
    best = np.maximum(chars / CHARACTERS, words / WORDS).argmin(1)
    at = np.arange(len(best))
    known = np.array([x is None or x in names for x in langs])
    c, w = np.where(known, chars[at, best], 0.0), np.where(known, words[at, best], 0.0)
    good = (c <= CHARACTERS) & (w <= WORDS) & ~np.array(failed, bool)
    return {"char_divergence": c.tolist(), "word_divergence": w.tolist(), "kept": good.tolist()}


def kept(docs: DataFrame, text: str = "text", key: str = "doc_id", label: str = "lang") -> DataFrame:
    """Rows that the rules keep, with all their columns, whatever their names.

    Texts are measured once: the counts and histograms that the verdict needs are written beside the
    rows. Null, empty and short texts go, as the base rules fail them; repeated rows stay or go
    together; an empty table stays empty.
    """

    @F.pandas_udf("base_failed boolean, n_words bigint, n_symbols bigint, hist binary")
    def measured(texts: pd.Series) -> pd.DataFrame:
        release()
        made = [measure(t or "") for t in texts]
        rows = [(base_fails(b), b[0], b[2], h.tobytes()) for b, h in made]
        return pd.DataFrame(rows, columns=["base_failed", "n_words", "n_symbols", "hist"])

    name = fresh(docs.columns, "measured")[0]
    rows = written(docs.withColumn(name, measured(F.col(text))), "measured")
    refs = references(rows.select(F.col(label).alias("lang"), f"{name}.*"))

    @F.pandas_udf("boolean")
    def good(langs: pd.Series, failed: pd.Series, hists: pd.Series) -> pd.Series:
        return pd.Series(verdicts(langs.tolist(), failed.tolist(), hists.tolist(), *refs)["kept"], dtype=bool)

    return rows.where(good(F.col(label), F.col(f"{name}.base_failed"), F.col(f"{name}.hist"))).select(*docs.columns)


def base_fails(base: list[int]) -> bool:
    return base[0] < LEAST_WORDS or 100 * base[4] > REPEATED * base[0]


def judged(rows: DataFrame, make) -> DataFrame:
    """Verdict columns beside the base counts, in one pass."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def both():
        verdict = make()

        def step(keys, langs, *columns):
            *base, failed, hists = columns
            return dict(zip(names, base)) | {"key": keys, "base_failed": failed} | verdict(langs, failed, hists)

        return step

    return arrow_map(rows.select("key", "lang", *names, "base_failed", "hist"),
                     "key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, char_divergence double, word_divergence double", both)
