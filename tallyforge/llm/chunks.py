"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes runs over the UTF-8 text. A boundary is a byte whose hash has its
top bits clear: a longer mask before the normal chunk size, a shorter one after it (normalised
chunking), within a least and a greatest size. A fingerprint is the set of chunk digests with their
lengths; likeness of A to B is the length of A's chunks found in B over the length of all of A's
(weighted containment). Boundaries depend on content only, so shifted text keeps its chunks.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import release, shuffle_partitions
from tallyforge.llm.dac import hash_share, key_ranges, streamed

LEAST, NORMAL, GREATEST = 16, 40, 160
#: Top bits that must be clear before and after the normal size.
HARD, EASY = np.uint32(0xFE000000), np.uint32(0xF0000000)


def gear_table() -> np.ndarray:
    """A pseudo-random 32-bit value per byte: a multiply-xorshift mix of its number."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hash(raw: bytes) -> np.ndarray:
    """Gear hash after each byte: the sum of table values, each shifted by its age (32 bits, so 32 bytes)."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4, 8, 16):  # sums over twice as many bytes each time
        if len(h) <= step:
            break
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def chunk_ends(raw: bytes) -> list[int]:
    n = len(raw)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hash(raw)
    easy = np.nonzero((h & EASY) == 0)[0]
    hard = (h[easy] & HARD) == 0
    spots, strict = easy.tolist(), hard.tolist()
    ends, begin, i, k = [], 0, 0, len(spots)
    while n - begin > LEAST:
        while i < k and spots[i] < begin + LEAST:
            i += 1
        limit, normal, j = min(begin + GREATEST, n), begin + NORMAL, i
        cut = limit
        while j < k and spots[j] + 1 < limit:
            if spots[j] >= normal or strict[j]:
                cut = spots[j] + 1
                break
            j += 1
        ends.append(cut)
        begin, i = cut, j
    if begin < n:
        ends.append(n)
    return ends


def chunk_set(text: str) -> dict[int, int]:
    """Digest (48 bits) to length of each distinct chunk."""
    import xxhash

    raw, begin, out = text.encode(), 0, {}
    for end in chunk_ends(raw):
        out[xxhash.xxh3_64_intdigest(raw[begin:end]) >> 16] = end - begin
        begin = end
    return out


def as_string(chunks: dict[int, int]) -> str:
    """Base64 of the sorted eight-byte records (48-bit digest, 16-bit length)."""
    packed = np.array(sorted(d << 16 | n for d, n in chunks.items()), ">u8")
    return base64.b64encode(packed.tobytes()).decode()


def from_string(fingerprint: str) -> dict[int, int]:
    packed = np.frombuffer(base64.b64decode(fingerprint), ">u8").tolist()
    return {x >> 16: x & 0xFFFF for x in packed}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of a's length whose chunks b has; two empty sets are alike, an empty a is in nothing else."""
    if not a:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def edited(text: str, following: str) -> str:
    """``text`` with its last half (floor) replaced by as many first code points of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Ranges with a bound of their own; more ranges come from equal steps inside these, so plans stay small.
MOST_CUTS = 512


def range_column(docs: DataFrame, column: str, key: str, wanted: int, text: str = "text"):
    """Number of the range of a row, about ``wanted`` ranges of like row counts, rising with the key; null keys come first.

    Also tells whether any key, or null, was divided.

    Reads the key column only. Up to ``MOST_CUTS`` quantiles make a search tree in generated code;
    beyond, each is divided into equal steps of the key. A key with several ranges' rows, and null,
    are divided by a hash of ``text``.
    """
    found = key_ranges(docs, key, min(wanted, MOST_CUTS))
    steps = -(-wanted // MOST_CUTS)
    nulls, widths = max(1, found.nulls * steps), [w * steps for w in found.widths]
    coarse = bucket_column(column, found.cuts)
    part = lambda share, n: F.greatest(F.lit(0), F.least(n - 1, F.floor(share * n).cast("int")))
    starts = F.array(*(F.lit(nulls + sum(widths[:i])) for i in range(len(widths))))
    within = F.lit(0)
    if steps > 1 and found.cuts:
        least, most = docs.agg(F.min(key), F.max(key)).first()
        lows, highs = F.array(*map(F.lit, [least, *found.cuts])), F.array(*map(F.lit, [*found.cuts, most]))
        low, high = F.get(lows, coarse).cast("double"), F.get(highs, coarse).cast("double")
        within = part((F.col(column).cast("double") - low) / F.greatest(high - low, F.lit(1.0)), F.lit(steps))
    if max(found.widths) > 1:
        wide = F.get(F.array(*map(F.lit, found.widths)), coarse)
        within = F.when(wide > 1, part(hash_share(F.col(text)), wide * steps)).otherwise(within)
    own = F.get(starts, coarse) + within
    none = part(hash_share(F.col(text)), F.lit(nulls)) if nulls > 1 else F.lit(0)
    return F.when(F.col(key).isNull(), none).otherwise(own).cast("int"), nulls > 1 or max(found.widths) > 1


def with_following(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, int]:
    """Rows dealt into key ranges, highest first, and beside each range a copy of the row that follows it.

    One shuffle of the texts. One key and hash per range pass through the driver and come back as a
    broadcast of that many rows.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    lowest = -(1 << 63)
    rows = docs.select(F.coalesce(F.col(key), F.lit(lowest)).alias("at"), F.col(key).alias("key"), F.col(text).alias("text"))
    range_of, divided = range_column(rows, "at", "key", 4 * parts)
    # texts are hashed, and so read twice, only where a key has several ranges
    order = F.xxhash64(F.coalesce("text", F.lit(""))) if divided else F.lit(0).cast("bigint")
    place = F.struct("at", order.alias("h"))
    tops = sorted((-r["r"], tuple(r["top"])) for r in rows.select(range_of.alias("r"), place.alias("top")).groupBy("r").agg(F.max("top").alias("top")).collect())
    # each range is followed by the top of the next lower one, the last by the first
    follows: dict[tuple[int, int], list[int]] = {}
    for (r, _), (_, top) in zip(tops, tops[1:] + tops[:1]):
        follows.setdefault(top, []).append(-r)
    copies = spark.createDataFrame([(*top, more) for top, more in follows.items()], "top_at bigint, top_h bigint, more array<int>")
    own = F.array(F.struct(range_of.alias("r"), F.lit(False).alias("copy")))
    more = F.transform(F.coalesce("more", F.array().cast("array<int>")), lambda r: F.struct(r.alias("r"), F.lit(True).alias("copy")))
    first = (F.col("at") == F.col("top_at")) & (order == F.col("top_h"))
    dealt = rows.join(F.broadcast(copies), first, "left").withColumn("to", F.explode(F.concat(own, more)))
    return dealt.select("to.r", "to.copy", "at", "key", "text"), parts


def bucket_column(column: str, cuts: list[int]):
    """Number of cuts at or below the column, as nested comparisons (a search tree in generated code)."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) >= F.lit(cuts[mid]), tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(cuts))


def document_fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprint of each text and of its edited text, and likenesses to that and to the next document.

    The next document is the one with the next smaller key, after the smallest the largest. Null
    text counts as empty; null keys come last; rows of one key follow each other by a falling hash of
    their text, then by text. Repeated rows come out repeated. A single row is its own next document.
    Texts of any length; other columns are ignored, whatever their names. Empty table: no rows.
    """
    rows, parts = with_following(docs, text, key)
    rows = rows.repartitionById(parts, "r").sortWithinPartitions("r", "copy", F.desc("at"), F.xxhash64(F.coalesce("text", F.lit(""))).desc(), F.coalesce("text", F.lit("")))

    def make():
        release()
        held: list[tuple] = []  # the row that waits for the one after it
        out: list[tuple] = []

        def pair(k, t, chunks, after, after_chunks):
            changed = edited(t, after)
            other = chunk_set(changed)
            out.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), as_string(chunks), as_string(other), containment(chunks, other), containment(chunks, after_chunks)))

        names = ("key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

        def step(ranges, copies, _, keys, texts):
            for r, copy, k, t in zip(ranges, copies, keys, texts):
                t = t or ""
                chunks = chunk_set(t)
                if held and held[0][0] == r:
                    pair(*held[0][1:], t, chunks)
                    held.clear()
                elif held:
                    raise RuntimeError("a key range lacks the row that follows it")
                if not copy:
                    held[:] = [(r, k, t, chunks)]
            return done()

        def done():
            made = {n: [row[i] for row in out] for i, n in enumerate(names)}
            out.clear()
            return made

        def last():
            if held:
                raise RuntimeError("a key range lacks the row that follows it")
            return done()

        return step, last

    made = streamed(rows, "key bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", make)
    return made.withColumnRenamed("key", key)
