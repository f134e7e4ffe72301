"""String functions of recognised text: Column in, Column out, all in generated code but NFKC."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole-line corrections of common recognition errors.
CORRECTIONS = {
    "T0TAL": "TOTAL",
    "TOTAI": "TOTAL",
    "T0TAl": "TOTAL",
    "SUBT0TAL": "SUBTOTAL",
    "AM0UNT": "AMOUNT",
    "INVCICE": "INVOICE",
    "RECElPT": "RECEIPT",
    "R3CEIPT": "RECEIPT",
}
#: Pattern and replacement of error variants inside a line.
VARIANTS = (
    (r"(?i)\bT[O0]T[A4]L\b(?=\s*[:\-]?\s*[$₹]?\s*\d)", "TOTAL"),
    (r"(?i)\bGRAND\s+T[O0]T[A4]L\b", "GRAND TOTAL"),
    (r"(?i)\bAM[O0]UNT\s+PAYABLE\b", "AMOUNT PAYABLE"),
)
SEPARATOR = r"^[\s\-_=*~.]{4,}$"
UNKNOWN_STORE = "__UNKNOWN_STORE__"


def each_line(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.split(c, r"\R"), f)


def strip(c: Column) -> Column:
    """Unicode-aware trim."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def squeeze(c: Column) -> Column:
    """Trimmed, every run of white space one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def nfkc(c: Column) -> Column:
    """Unicode NFKC; Spark has none, so Arrow batches go to Python. ASCII rows come back as they are."""
    return F.pandas_udf(_nfkc, "string")(c)


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(c, r"[\p{C}&&[^\n\t\r]]", "")


def normalize_whitespace(c: Column) -> Column:
    lines = each_line(c, lambda x: F.regexp_replace(strip(x), r"[ \t]+", " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def correct_line(line: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in CORRECTIONS.items() for x in kv])
    bare = strip(line)
    out = F.coalesce(F.when(bare != "", F.replace(line, bare, F.try_element_at(known, bare))), line)
    for pattern, word in VARIANTS:
        out = F.regexp_replace(out, pattern, word)
    return out


def correct_errors(c: Column) -> Column:
    return F.array_join(each_line(c, correct_line), "\n")


def squeeze_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"([.,:;!?])\1{2,}", "$1")


def strip_currency(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?i)(?:₹|rs\.?|inr|r\s*s\.?)\s*(?=\d)", "")
    out = F.regexp_replace(out, r"(?i)\bI\s*N\s*R\b", "")
    return F.regexp_replace(out, r"(?i)\bR\s*S\b(?=\s*\d)", "")


def drop_noise_lines(c: Column) -> Column:
    lines = F.filter(each_line(c, strip), lambda x: (x != "") & ~x.rlike(SEPARATOR))
    return F.array_join(lines, "\n")


def drop_adjacent_repeats(c: Column) -> Column:
    lines = F.split(c, r"\R")
    kept = F.filter(lines, lambda x, i: (i == 0) | (strip(x) != strip(F.get(lines, i - 1))))
    return F.array_join(kept, "\n")


def bare_store(c: Column) -> Column:
    """Capital letters and digits of a store name, words apart by one space; maybe empty."""
    return F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", " "))


def canonical_store(c: Column) -> Column:
    key = bare_store(c)
    return F.coalesce(F.when(key != "", key), F.lit(UNKNOWN_STORE))


def display_store(c: Column) -> Column:
    name = squeeze(c)
    return F.when(name != "", name)


@lru_cache(1)
def _folds() -> tuple[str, str, list[tuple[str, str]]]:
    """What full case folding does to characters that lower case leaves: one-to-one pairs, and longer results."""
    made = [(c, f) for c in map(chr, range(128, sys.maxunicode + 1)) if not 0xD800 <= ord(c) < 0xE000 and c.lower() == c and (f := c.casefold()) != c]
    short = [(c, f) for c, f in made if len(f) == 1]
    return "".join(c for c, _ in short), "".join(f for _, f in short), [(c, f) for c, f in made if len(f) > 1]


def casefold(c: Column) -> Column:
    """Full case folding: lower case, then the characters that fold further; ASCII text needs the first only."""
    old, new, longer = _folds()
    low = F.lower(c)
    one = F.when(low.rlike(f"[{old}]"), F.translate(low, old, new)).otherwise(low)
    pairs = F.split(F.lit(" ".join(x + y for x, y in longer)), " ")
    full = F.when(one.rlike("[" + "".join(x for x, _ in longer) + "]"), F.aggregate(pairs, one, lambda t, p: F.replace(t, F.substring(p, 1, 1), F.substring(p, 2, 9)))).otherwise(one)
    return F.when(c.rlike(r"[^\x00-\x7F]"), full).otherwise(low)


def evaluation_text(c: Column, case_sensitive: bool = False, whitespace: bool = True, punctuation: bool = False) -> Column:
    """Text as compared by the evaluation, its case folded; punctuation is dropped on demand."""
    out = squeeze(c) if whitespace else c
    out = out if case_sensitive else casefold(out)
    return squeeze(F.regexp_replace(out, r"(?U)[^\p{L}\p{N}_\s]", "")) if punctuation else out


def sanitize_name(c: Column, longest: int = 250) -> Column:
    """Name for a run log: allowed characters only, at most ``longest`` of them."""
    out = F.regexp_replace(F.trim(c), r"[^A-Za-z0-9_.\-/ ]+", "_")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+", "_"), r"^[._\-/]+|[._\-/]+$", "")
    return F.substring(F.coalesce(F.when(out != "", out), F.lit("unnamed")), 1, longest)


#: Patterns and replacements of what never reaches a log.
REDACTIONS = (
    (r"([a-zA-Z][a-zA-Z0-9+.-]*://)([^/@\s:]+):([^/@\s]+)@", "$1***:***@"),
    (r"(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]+", "$1 ***"),
    (r"(?i)\b(token|api[_-]?key|secret)\s*=\s*([^\s&;]+)", "$1=***"),
)


def redact(c: Column) -> Column:
    """URL credentials, bearer tokens and key=value secrets masked."""
    for pattern, mask in REDACTIONS:
        c = F.regexp_replace(c, pattern, mask)
    return c


def truncate(c: Column, longest: int) -> Column:
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest - 3), F.lit("..."))).otherwise(c)


def letters(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{Nd}]", ""))


def similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """1 - edit distance / longer length, of compared texts; 0 if either is empty.

    Below ``least`` the result is 0: the distance is given up once it passes what could still reach it.
    """
    longest = F.greatest(F.length(a), F.length(b))
    distance = F.call_function("levenshtein", a, b, F.floor(longest * (1 - least) + 1e-6).cast("int")) if least else F.levenshtein(a, b)
    value = F.when(distance >= 0, 1 - distance / longest).otherwise(0.0)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.when(value >= least, value).otherwise(0.0))


def place(values: Column, x: Column) -> Column:
    """How many of the sorted values are less than ``x``, by binary search."""

    def halved(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        above = F.struct((middle + 1).alias("low"), a["high"].alias("high"))
        below = F.struct(a["low"].alias("low"), middle.alias("high"))
        return F.when(a["low"] >= a["high"], a).when(F.get(values, middle) < x, above).otherwise(below)

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), F.size(values).alias("high")), halved, lambda a: a["low"])


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance over words: distinct words become code points, then ``levenshtein``.

    Code points run from U+4E00 up to U+D7FF and from U+10000 up to U+10FFFF, a word's being its
    place among the sorted ones. A pair of over 1,083,904 distinct words raises an error.
    """

    def coded(ws: Column, known: Column) -> Column:
        point = lambda n: F.when(n < 0xD800 - 0x4E00, n + 0x4E00).otherwise(n - (0xD800 - 0x4E00) + 0x10000)
        return F.decode(F.unhex(F.array_join(F.transform(F.transform(ws, lambda w: place(known, w)), lambda n: F.lpad(F.hex(point(n)), 8, "0")), "")), "UTF-32")

    def both(x: Column) -> Column:
        known = F.array_sort(F.array_distinct(F.concat(x["a"], x["b"])))
        return F.get(F.transform(F.array(known), lambda v: F.levenshtein(coded(x["a"], v), coded(x["b"], v))), F.lit(0))

    return F.get(F.transform(F.array(F.struct(words(a).alias("a"), words(b).alias("b"))), both), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def url_file_id(c: Column, marker: str = "/file/d/", parameter: str = "id") -> Column:
    """Id after the marker in a URL's path, else the query parameter; null if there is neither."""
    path = F.try_parse_url(c, F.lit("PATH"))
    parts = F.split(path, marker)
    own = F.trim(F.split_part(F.get(parts, F.lit(1)), F.lit("/"), F.lit(1)))
    given = F.trim(F.try_parse_url(c, F.lit("QUERY"), F.lit(parameter)))
    return F.coalesce(F.when((F.size(parts) == 2) & (own != ""), own), F.when(given != "", given))
