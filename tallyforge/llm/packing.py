"""Best-fit packing with vector capacities.

Every sequence has three residual capacities: tokens, documents and attention cost (sum of squared
lengths). Pieces go longest first to the open sequence that fits under every constraint and has the
best score: the smallest weighted norm of what would remain, or the largest weighted dot product of
need and residual. Pieces are dealt to groups by a hash, so a group's size is bounded and the waste
is at most one open sequence or so per group of some thousand pieces.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import UNSETTLED, byte_symbols
from tallyforge.llm.common import arrow_map, held, tokenizer_path, written

#: Pieces in a packing group, about.
GROUP = 8192
#: Weights of residual tokens, documents and attention cost; with equal ones sf0.1 takes as many sequences (4937) as with tokens alone.
WEIGHTS = (1.0, 1.0, 1.0)


class ByteBPE:
    """Byte-level BPE ids of a tokenizers file, through the merge ranks that the file holds."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={k: v for k, v in ranks.items() if v not in self.special.values()}, special_tokens=self.special)
        self.path = path
        self.library = None

    def encode(self, text: str) -> np.ndarray:
        if UNSETTLED.search(text) or max(map(len, text.split()), default=0) > 10_000:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


def byte_encoder(path: str) -> ByteBPE:
    return held(("bytes", path), lambda: ByteBPE(path))


def pieces(docs: DataFrame, path: str | None = None, length: int = 2048, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, piece, start, length, ids_crc32`` of every document; a cut document's first piece is the shorter one."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def make():
        bpe = byte_encoder(path)
        end = np.array([end_id], "<u4")

        def step(keys, texts):
            out = {"key": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            for k, t in zip(keys, texts):
                ids = np.concatenate((bpe.encode(t or "").astype("<u4", copy=False), end))
                n = len(ids)
                cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    for name, v in zip(out, (k, i, a, z - a, zlib.crc32(ids[a:z].tobytes()))):
                        out[name].append(v)
            return out

        return step

    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint", make)


def fit(lengths: np.ndarray, tokens: int, documents: int, attention: float, weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (given longest first)."""
    n = len(lengths)
    seq, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    cap = np.array([tokens, documents, attention], float)
    scale = np.sqrt(np.array(weights)) / cap
    left = np.empty((3, n))
    ids = np.empty(n, np.int64)
    open_, made = 0, 0
    least = int(lengths[-1]) if n else 0
    for i, size in enumerate(lengths.tolist()):
        need = np.array([size, 1.0, float(size) * size])
        at = -1
        if open_:
            now = left[:, :open_]
            ok = np.nonzero((now[0] >= need[0]) & (now[1] >= need[1]) & (now[2] >= need[2]))[0]
            if len(ok):
                if rule == "norm":
                    after = (now[:, ok] - need[:, None]) * scale[:, None]
                    at = ok[np.argmin((after * after).sum(0))]
                else:
                    at = ok[np.argmax(((need * scale * scale)[:, None] * now[:, ok]).sum(0))]
        if at < 0:
            at = open_
            left[:, at], ids[at] = cap, made
            made, open_ = made + 1, open_ + 1
        seq[i], offset[i] = ids[at], tokens - left[0, at]
        left[:, at] -= need
        if left[0, at] < least or left[1, at] < 1:  # nothing fits any more
            open_ -= 1
            left[:, at], ids[at] = left[:, open_], ids[open_]
    return seq, offset


def best_fit(docs: DataFrame, path: str | None = None, length: int = 2048, max_documents: int | None = None, max_attention: float | None = None,
             weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm", end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pack all documents: ``key, piece, start, length, ids_crc32, sequence_id, offset``.

    Unset capacities are those that the token capacity implies (``length`` documents, ``length``
    squared attention), so they never cost a sequence, but all three residuals decide which sequence a
    piece goes to. Null text: the end id alone; null keys stay null. Empty table: no rows. Repeated
    rows are packed each for itself, over several groups; texts of any length are cut; ties go by key
    and piece. Other columns are ignored, whatever their names.
    """
    if max_attention is not None and max_attention < length * length:
        raise ValueError("a full piece alone costs length * length attention")
    rows = written(pieces(docs, path, length, end_id, text, key), "pieces")
    groups = max(1, -(-rows.count() // GROUP))
    caps = (length, max_documents or length, float(max_attention or length * length))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "key", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        seq, offset = fit(frame["length"].to_numpy(), *caps, weights, rule)
        frame["sequence_id"] = seq + (int(frame["g"].iloc[0]) << 32)
        frame["offset"] = offset
        return frame.drop(columns="g")

    rows = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))  # of places, so equal rows spread too
    out = rows.groupBy("g").applyInPandas(pack, "key bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("key", key)
