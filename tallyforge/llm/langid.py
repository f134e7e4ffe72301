"""Language ID by unigram piece models with segmentations summed out.

For each language the pieces of a fixed public vocabulary have probabilities, fitted by EM on a
bounded sample of labelled documents. The probability of a word is the sum over all its
segmentations into pieces (a forward pass over end positions); a text's score is the product over
its words, and the answer the language with the greatest posterior under equal priors.

A text is scored by its words, the runs of letters in lower case, each from a word-start mark to its
end; pieces that hold anything else have no place in them. Words of one length go through the
forward pass together as array rows, once per new word of a worker; texts then only look up their
words. Sums are rescaled on the way, so words may have any length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import arrow_map, held, tokenizer_path

#: Bound of the labelled sample: documents per language.
SAMPLE_DOCS = 250
#: EM rounds, and the most letters of a word that trains (a bound of the sample; every word is scored).
ROUNDS, TRAIN_LETTERS = 3, 1000
#: Probability of a character outside the vocabulary, and the least of any piece.
UNKNOWN, FLOOR = 1e-8, 1e-7
#: Letters after which sums are rescaled: 16 unknown characters make 1e-128, far from the least double.
RESCALE = 16
#: Words of more letters go through the forward pass alone; few share a length.
ALONE = 64
CACHE = 250_000
#: Least posterior with which a filter accepts a document.
LEAST_SCORE = 0.4
LETTERS = regex.compile(r"\p{L}+")
MARK = "▁"
BASE = np.uint64(0x100000001B3)
LOW = np.uint64((1 << 20) - 1)


def vocabulary(path: str) -> list[str]:
    """Every piece of a sentencepiece model, in lower case; the word-start mark stays."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return sorted({model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})


class Lattice:
    """Piece number of every span of words, found by a rolling hash."""

    def __init__(self, pieces: list[str]):
        made: dict[int, int] = {}
        starts: set[int] = set()
        for i, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(BASE) + ord(c)) & 0xFFFFFFFFFFFFFFFF
                starts.add(h)
            made.setdefault(h, i)
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)
        order = sorted(made)
        self.keys = np.array([*order, 2**64 - 1], np.uint64)
        self.value = np.array([*(made[h] for h in order), 0], np.int64)
        self.opens = np.zeros(1 << 20, bool)  # whether any piece may begin with what has these low hash bits
        self.opens[(np.fromiter(starts, np.uint64, len(starts)) & LOW).astype(np.int64)] = True

    def spans(self, words: list[str]):
        """``i, j, rows, pieces`` of all spans of words of one length, rising with i; a lone character without a piece is unknown."""
        n, m = len(words[0]), len(words)
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(m, n).T.astype(np.uint64)
        for i in range(n):
            live, h = np.arange(m), np.zeros(m, np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * BASE + code[j - 1][live]
                at = np.searchsorted(self.keys, h)
                hit = self.keys[at] == h
                if j == i + 1:
                    yield i, j, live, np.where(hit, self.value[at], self.unknown)
                elif hit.any():
                    yield i, j, live[hit], self.value[at[hit]]
                on = self.opens[(h & LOW).astype(np.int64)]
                if not on.all():
                    live, h = live[on], h[on]
                    if not len(live):
                        break


def by_length(words) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def fit(counts: dict[str, dict[str, int]], pieces: list[str]) -> dict:
    """Piece probabilities of each language from its word counts, by EM over all segmentations (in logarithms)."""
    lattice = Lattice(pieces)
    langs = sorted(counts)
    prob = np.zeros((len(pieces) + 1, len(langs)))
    for k, lang in enumerate(langs):
        seen = {MARK + w: n for w, n in counts[lang].items()}
        groups = [(list(lattice.spans(ws)), n, np.array([seen[w] for w in ws], float)) for n, ws in by_length(seen).items()]
        p = np.full(len(pieces) + 1, 1 / max(1, len(pieces)))
        p[-1] = UNKNOWN
        for _ in range(ROUNDS):
            got = np.zeros(len(p))
            for spans, n, weight in groups:
                got += expected(spans, n, weight, p)
            got = got[:-1] + 1e-3
            p[:-1] = np.maximum(got / got.sum(), FLOOR)
        prob[:, k] = p
    return {"langs": langs, "pieces": pieces, "prob": prob}


def expected(spans: list[tuple], n: int, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of weighted words of n characters."""
    plain = n <= 2 * RESCALE  # longer words in logarithms
    one, none, plus, times, p = (1.0, 0.0, np.add, np.multiply, p) if plain else (0.0, -np.inf, np.logaddexp, np.add, np.log(p))
    alpha, beta = np.full((n + 1, len(weight)), none), np.full((n + 1, len(weight)), none)
    alpha[0] = beta[n] = one
    for i, j, rows, piece in spans:
        alpha[j][rows] = plus(alpha[j][rows], times(alpha[i][rows], p[piece]))
    for i, j, rows, piece in reversed(spans):
        beta[i][rows] = plus(beta[i][rows], times(beta[j][rows], p[piece]))
    got = np.zeros(len(p))
    for i, j, rows, piece in spans:
        use = times(times(alpha[i][rows], p[piece]), beta[j][rows])
        share = use / alpha[n][rows] if plain else np.exp(use - alpha[n][rows])
        got += np.bincount(piece, weight[rows] * share, len(p))
    return got


#: ASCII bytes other than letters become spaces, capitals small; bytes of other characters stay.
CLEAN = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Scorer:
    """Log-probabilities of words in each language, kept for later texts."""

    def __init__(self, model: dict):
        self.prob, self.lattice = model["prob"], Lattice(model["pieces"])
        self.width = self.prob.shape[1] + 1
        self.index = {p: i for i, p in enumerate(model["pieces"])}
        self.opens = {p[:k] for p in self.index for k in range(1, len(p) + 1)}
        self.clear()

    def clear(self):
        self.at: dict[bytes, int] = {}
        self.table = np.zeros((1024, self.width), np.float32)

    def sums(self, words: list[str]) -> np.ndarray:
        """Log of the summed segmentations of words of one length, for each language: a forward pass over a ring of end positions."""
        size, n = self.lattice.longest + 1, len(words[0])
        ring = np.zeros((size, len(words), self.width - 1))
        scale = np.zeros(ring.shape[1:])
        ring[0] = 1
        at = 0
        for i, j, rows, piece in self.lattice.spans(words):
            if i > at:
                ring[at % size] = 0
                at = i
                if i % RESCALE == 0:
                    top = ring.max(0)
                    ring /= top
                    scale += np.log(top)
            ring[j % size][rows] += ring[i % size][rows] * self.prob[piece]
        return np.log(ring[n % size]) + scale

    def sum_alone(self, word: str) -> np.ndarray:
        """``sums`` of one word, with its spans looked up one by one."""
        size, n = self.lattice.longest + 1, len(word)
        ring = np.zeros((size, self.width - 1))
        scale = np.zeros(self.width - 1)
        ring[0] = 1
        for i in range(n):
            if i and i % RESCALE == 0:
                top = ring.max(0)
                ring /= top
                scale += np.log(top)
            own = ring[i % size].copy()
            ring[i % size] = 0
            for j in range(i + 1, min(n, i + size - 1) + 1):
                span = word[i:j]
                k = self.index.get(span)
                if k is not None:
                    ring[j % size] += own * self.prob[k]
                elif j == i + 1:
                    ring[j % size] += own * UNKNOWN
                if span not in self.opens:
                    break
        return np.log(ring[n % size]) + scale

    def learn(self, words: set[bytes]):
        found = {w: [MARK + x for x in LETTERS.findall(w.decode())] for w in words}
        known = {}
        for n, group in by_length({r for rs in found.values() for r in rs}).items():
            if n > ALONE:
                known.update((w, self.sum_alone(w)) for w in group)
                continue
            for at in range(0, len(group), 10_000):
                part = group[at : at + 10_000]
                known.update(zip(part, self.sums(part)))
        n = len(self.at)
        while n + len(found) > len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        for i, (w, rs) in enumerate(found.items(), n):
            self.at[w] = i
            self.table[i, -1] = len(rs)
            self.table[i, :-1] = known[rs[0]] if len(rs) == 1 else sum((known[r] for r in rs), np.zeros(self.width - 1))

    def totals(self, texts: list[str | None]) -> np.ndarray:
        """Per text: log-likelihood in each language, and the number of words."""
        split = [(t or "").lower().encode().translate(CLEAN).split() for t in texts]
        if len(self.at) > CACHE:
            self.clear()
        self.learn(set().union(*split).difference(self.at.keys()))
        out = np.zeros((len(texts), self.width))
        for i, words in enumerate(split):
            if words:
                out[i] = self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
        return out


def scorer(model: dict, name: str) -> Scorer:
    """The worker's scorer of this model."""
    return held(("langid", name), lambda: Scorer(model))


def train(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", label: str = "lang", sample: int = SAMPLE_DOCS) -> dict:
    """Model from at most ``sample`` documents per language, those with the smallest key hashes.

    Keys are chosen from the key and label columns alone; whole texts are then read for those only.
    """
    import uuid

    order = Window.partitionBy(label).orderBy(F.xxhash64(key), key)
    chosen = docs.where(F.col(label).isNotNull()).select(key, label).withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample)
    rows = docs.select(key, text, label).join(F.broadcast(chosen.select(key).distinct()), key, "left_semi").where(F.col(label).isNotNull())
    words = rows.select(F.col(label).alias("label"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"))).alias("word")).where(F.length("word") <= TRAIN_LETTERS)
    counts: dict[str, dict[str, int]] = {}
    for r in words.groupBy("label", "word").count().toLocalIterator():  # the distinct words of the sample
        counts.setdefault(r["label"], {})[r["word"]] = r["count"]
    pieces = vocabulary(path or tokenizer_path("piece_bpe_32k.model"))
    return fit(counts, pieces) | {"name": uuid.uuid4().hex}


def predict(docs: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, lang_pred, score`` (posterior) per row.

    Null text, a text without letters, or a model without languages: ``und`` with score 0. Equal
    posteriors: the first language by name. Repeated rows come out repeated, each alike; other columns
    are ignored, whatever their names. Empty table: no rows.
    """
    langs = model["langs"]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB at most: vocabulary x languages
    name = model["name"]

    def make():
        def step(keys, texts):
            mine = scorer(sent.value, name)
            pred, score = [], []
            for at in range(0, len(texts), 1024):
                total = mine.totals(texts[at : at + 1024])
                for row in total:
                    if not langs or not row[-1]:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    best = int(row[:-1].argmax())
                    pred.append(langs[best])
                    score.append(float(1 / np.exp(row[:-1] - row[best]).sum()))
            return {"key": keys, "lang_pred": pred, "score": score}

        return step

    out = arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key bigint, lang_pred string, score double", make)
    return out.withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: dict, least: float = LEAST_SCORE, text: str = "text") -> DataFrame:
    """Rows whose language is told with a posterior of ``least`` or more; all columns stay as they are.

    A model without languages tells none, so no row is accepted. Null text and text without letters
    go; repeated rows stay or go together; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = model["name"]

    @F.pandas_udf("boolean")
    def told(texts: pd.Series) -> pd.Series:
        mine = scorer(sent.value, name)
        out = []
        rows = texts.tolist()
        for at in range(0, len(rows), 1024):
            for row in mine.totals(rows[at : at + 1024]):
                top = row[:-1].max(initial=-np.inf)
                out.append(bool(top > -np.inf and row[-1] > 0 and 1 / np.exp(row[:-1] - top).sum() >= least))
        return pd.Series(out, dtype=bool)

    return docs.where(told(F.col(text)))


def held_out(key: str = "doc_id"):
    """Documents that training never sees: crc32 of the decimal key, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def language_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; learned without the held-out documents.

    Nulls, ties, repeated rows, extra columns and the empty table as in ``predict``; a null key is not held out.
    """
    model = train(docs.where(~held_out()), path)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
