"""BPE with word ends over a public vocabulary: contiguous rank arrays.

A word of n symbols holds n part boundaries and the ranks of its n-1 adjacent pairs in one
contiguous array. The minimum rank is found by a scan, its boundary deleted, and the two ranks
beside it looked up again, until no pair has a rank. Short words go through in blocks: the rows of
a matrix are words, so every scan, deletion and refresh is one array operation over all of them.
Words over ``SHORT`` symbols use a heap over the same ranks, as repeated scans would be quadratic.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import cached_property

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_map, held, tokenizer_path

#: Longest word, in symbols, that the matrix path takes.
SHORT = 40
#: Entries a worker's cache holds before it starts over (memory bound).
CACHE = 400_000
NONE = np.int32(2**31 - 1)

#: The word pattern of the vocabulary file, and characters that Python's str.split
#: treats as white space but the file's pattern does not.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Characters outside the blocks whose classes and case have not changed between Unicode versions.
UNSETTLED = re.compile("[^\u0000-\u052f\u0600-\u06ff\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf\u2100-\u214f\u2190-\u2bff\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001f64f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


class RankArrayBPE:
    """Encoder and decoder with the ids of the tokenizers library for a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        size = max(self.token) + 1
        self.tokens = [self.token.get(i, "") for i in range(size)]
        self.decimals = [str(i) for i in range(size)]
        self.bytes = byte_symbols()
        self.inner = np.array([vocab[c] for c in self.bytes], np.int64)
        self.last = np.array([vocab[c + self.end] for c in self.bytes], np.int64)
        pairs = [(vocab[a] << 20 | vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(map(tuple, model["merges"]))]
        order = sorted(pairs)
        self.keys = np.array([k for k, _, _ in order] + [1 << 62], np.int64)
        self.rank = np.array([r for _, r, _ in order] + [NONE], np.int32)
        self.made = np.array([m for *_, m in sorted((r, m) for _, r, m in pairs)], np.int64)
        self.find = {k: r for k, r, _ in pairs}
        self.words = regex.compile(WORDS)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.path = path

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    # -- merges ------------------------------------------------------------------------------
    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def block(self, words: list[bytes]) -> list[bytes]:
        """Words of one length through the matrix path; ids come packed as little-endian uint32."""
        n, rows = len(words[0]), len(words)
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(rows, n)
        part = np.empty((rows, n), np.int64)
        part[:, : n - 1], part[:, n - 1] = self.inner[raw[:, : n - 1]], self.last[raw[:, n - 1]]
        rank = self.ranks(part[:, :-1], part[:, 1:])
        out: list[bytes] = [b""] * rows
        who = np.arange(rows)
        for k in range(n, 0, -1):  # every row still here has k parts
            at = np.arange(len(who))
            low = rank.argmin(1) if k > 1 else at * 0
            best = rank[at, low] if k > 1 else np.full(len(who), NONE)
            done = best == NONE
            if done.any():
                packed, w = part[done].astype("<u4").tobytes(), 4 * k
                for j, i in enumerate(who[done].tolist()):
                    out[i] = packed[j * w : j * w + w]
                go = ~done
                who, part, rank, low, best = who[go], part[go], rank[go], low[go], best[go]
                at = np.arange(len(who))
            if not len(who):
                break
            part[at, low] = self.made[best]
            kept = np.ones(part.shape, bool)
            kept[at, low + 1] = False
            part = part[kept].reshape(len(who), k - 1)  # the boundary after `low` is gone
            kept = np.ones(rank.shape, bool)
            kept[at, low] = False
            rank = rank[kept].reshape(len(who), k - 2)
            has = np.nonzero(low > 0)[0]
            rank[has, low[has] - 1] = self.ranks(part[has, low[has] - 1], part[has, low[has]])
            has = np.nonzero(low < k - 2)[0]
            rank[has, low[has]] = self.ranks(part[has, low[has]], part[has, low[has] + 1])
        return out

    def long(self, word: bytes) -> bytes:
        """One long word, by a heap of pair ranks over linked parts."""
        part = [int(self.inner[b]) for b in word[:-1]] + [int(self.last[word[-1]])]
        n = len(part)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := self.find.get(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j < 0 or part[j] != b:
                continue
            part[i], part[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := self.find.get(part[x] << 20 | part[y])) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return np.array([p for p in part if p >= 0], "<u4").tobytes()

    # -- texts -------------------------------------------------------------------------------
    def normal(self, text: str) -> str:
        """Composed, then lower case character by character (no final-sigma rule)."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of new chunks (runs without white space) into the cache."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        pieces = {c: self.words.findall(c) for c in chunks}
        by: dict[int, list[tuple[str, bytes]]] = {}
        for w in {w for ws in pieces.values() for w in ws}.difference(self.cache.keys()):
            raw = w.encode()
            if len(raw) > SHORT:
                self.cache[w] = self.long(raw)
            else:
                by.setdefault(len(raw), []).append((w, raw))
        for group in by.values():
            for at in range(0, len(group), 20_000):
                block = group[at : at + 20_000]
                self.cache.update(zip([w for w, _ in block], self.block([r for _, r in block])))
        got = self.cache.__getitem__
        for c, ws in pieces.items():
            self.chunks[c] = got(ws[0]) if len(ws) == 1 else b"".join(map(got, ws))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32.

        Strings of special tokens in a text become their ids, as in the library. Texts with a
        character on which Unicode versions may differ are split into words by the library's tables;
        merges are ours for all.
        """
        parts: list[list[list[str] | bytes]] = []
        new: set[str] = set()
        for text in texts:
            row: list[list[str] | bytes] = []
            has = "<|" in text and self.split_special is not None
            unsettled = UNSETTLED.search(text)
            for piece in self.split_special.split(text) if has else (text,):
                if has and piece in self.special:
                    row.append(np.array([self.special[piece]], "<u4").tobytes())
                    continue
                if unsettled:
                    row.append(b"".join(map(self.merged, self.library_words(piece))))
                    continue
                norm = self.normal(piece)
                chunks = [c for c in regex.split(r"\s+", norm) if c] if ODD_SPACE.search(norm) else norm.split()
                new.update(chunks)
                row.append(chunks)
            parts.append(row)
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        self.learn(new.difference(self.chunks.keys()))
        got = self.chunks.__getitem__
        return [
            b"".join(map(got, row[0]))
            if len(row) == 1 and isinstance(row[0], list)
            else b"".join(x if isinstance(x, bytes) else b"".join(map(got, x)) for x in row)
            for row in parts
        ]

    def library_words(self, text: str) -> list[bytes]:
        """Words of a text by the library's normaliser and splitter, as bytes."""
        back = {c: b for b, c in enumerate(self.bytes)}
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(back[c] for c in word) for word, _ in found]

    def merged(self, word: bytes) -> bytes:
        return self.long(word) if len(word) > SHORT else self.block([word])[0]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [np.frombuffer(x, "<u4").tolist() for x in self.encode_packed(texts)]

    def decode(self, ids: list[int]) -> str:
        """The vocabulary file has no decoder, so tokens are joined by one space."""
        return " ".join(map(self.tokens.__getitem__, ids))


class StreamingBPE(RankArrayBPE):
    """The same ids, text by text, with a compiled merge loop: for jobs that only need packed ids.

    The end-of-word mark becomes the byte 0xFF, which no UTF-8 text holds. Joining it to the last
    byte has the lowest rank, so that happens first; then merges follow in their own order, by the
    bytes they make. The cache fills itself on a miss and starts over when full.
    """

    class Cache(dict):
        def __init__(self, make):
            super().__init__()
            self.make = make

        def __missing__(self, chunk: str) -> bytes:
            if len(self) > StreamingBPE.MOST:
                self.clear()
            made = self[chunk] = self.make(chunk)
            return made

    MOST = 250_000

    def __init__(self, path: str):
        super().__init__(path)
        import tiktoken

        back = {c: bytes([b]) for b, c in enumerate(self.bytes)}

        def raw(token: str) -> bytes:
            whole = token.removesuffix(self.end) if self.end else token
            return b"".join(back[c] for c in whole) + (b"\xff" if whole != token else b"")

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        ids = dict(enumerate(self.inner.tolist())) | {256 + b: int(i) for b, i in enumerate(self.last[:255].tolist())}
        for r, made in enumerate(self.made.tolist()):
            ranks.setdefault(raw(self.token[made]), 512 + r)
            ids[512 + r] = made
        self.packed = [np.array([ids.get(r, 0)], "<u4").tobytes() for r in range(512 + len(self.made))]
        self.merge = tiktoken.Encoding("word-end", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.chunks = self.Cache(self.chunk)

    def chunk(self, chunk: str) -> bytes:
        words = (chunk,) if chunk.isascii() and chunk.isalpha() else self.words.findall(chunk)
        return b"".join(self.packed[r] for w in words for r in self.merge(w.encode() + b"\xff"))

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        return [self.encode_one(t) for t in texts]

    def encode_one(self, text: str) -> bytes:
        if UNSETTLED.search(text) or "<|" in text:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        norm = self.normal(text)
        chunks = [c for c in regex.split(r"\s+", norm) if c] if ODD_SPACE.search(norm) else norm.split()
        return b"".join(map(self.chunks.__getitem__, chunks))


def encoder(path: str, streaming: bool = False) -> RankArrayBPE:
    """One encoder, with its cache, per worker process and kind; other operators' caches make room."""
    return held(("bpe", path, streaming), lambda: (StreamingBPE if streaming else RankArrayBPE)(path))


def bpe_round_trip(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode and decode every text: ``key, n_tokens, ids (binary, little-endian uint32), decoded``.

    A null text counts as empty: no ids, empty decoded text. A null key stays null; other columns
    of the input are ignored. Rows map one to one, so repeated rows come out repeated.
    """
    path = path or tokenizer_path("word_bpe_49k.json")

    def make():
        bpe = encoder(path)

        def step(keys, texts):
            packed = bpe.encode_packed([t or "" for t in texts])
            made = [np.frombuffer(x, "<u4").tolist() for x in packed]
            return {
                "key": keys,
                "n_tokens": [len(i) for i in made],
                "ids": packed,
                "decoded": [bpe.decode(i) for i in made],
            }

        return step

    out = arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key bigint, n_tokens bigint, ids binary, decoded string", make)
    return out.withColumnRenamed("key", key)


def bpe_digests(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``bpe_round_trip`` with digests in place of ids and text, made in the worker so neither leaves it."""
    import hashlib

    path = path or tokenizer_path("word_bpe_49k.json")

    def make():
        bpe = encoder(path)
        word = bpe.decimals.__getitem__

        def step(keys, texts):
            sizes, ids, decoded = [], [], []
            for at in range(0, len(texts), 512):
                for made in bpe.encode([t or "" for t in texts[at : at + 512]]):
                    sizes.append(len(made))
                    ids.append(hashlib.sha256(" ".join(map(word, made)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(made).encode()).hexdigest())
            return {"key": keys, "n_tokens": sizes, "ids_sha256": ids, "decoded_sha256": decoded}

        return step

    out = arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", make)
    return out.withColumnRenamed("key", key)
