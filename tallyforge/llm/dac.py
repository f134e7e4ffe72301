"""Token-id files of directly addressable codes.

A shard file holds the ids of consecutive documents. Each id is split into chunks of the shard's
level widths; level j stores the j-th chunk of the ids that reach it, one continuation bit each
(set: the id goes on at level j+1), and a rank directory (set bits before each 512-bit block). Id i
is found by reading chunk i of level 0 and, while the bit is set, going on at rank(i): any token is
read without decoding its neighbours.

Layout, little-endian: magic ``TFDAC1``, u16 number of levels, u64 ids, u64 documents, then per
level u8 width and u64 entries; then doc ids (i64), null-key flags (u8), lengths (u32), and per
level the byte planes, the nibble plane (widths 4 and 12), the bitmap and the directory (u32).
Shards travel as rows of a Parquet table (``shard, first, payload``): Spark's commit protocol then
makes them atomic on any store, and no executor writes to a local path.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.bpe import encoder
from tallyforge.llm.common import arrow_map, shuffle_partitions, tokenizer_path, written

MAGIC = b"TFDAC1"
BLOCK = 512
#: Ids that close a shard.
SHARD_IDS = 1 << 18
WIDTHS = (4, 8, 12, 16)


def level_widths(ids: np.ndarray) -> list[int]:
    """Widths with the fewest bits for these ids, by dynamic programming over bit lengths."""
    bits = np.zeros(len(ids), np.int64) if not len(ids) else np.frexp(ids.astype(np.float64))[1]
    top = max(1, int(bits.max(initial=1)))
    reach = [int((bits > k).sum()) if k else len(ids) for k in range(top + 1)]  # ids with chunks from bit k on
    best: dict[int, tuple[int, list[int]]] = {}

    def plan(k: int) -> tuple[int, list[int]]:
        if k >= top:
            return 0, []
        if k not in best:
            best[k] = min(((reach[k] * (w + 1) + (rest := plan(k + w))[0], [w, *rest[1]]) for w in WIDTHS), key=lambda x: (x[0], len(x[1])))
        return best[k]

    return plan(0)[1]


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    widths = level_widths(ids)
    head, body = [MAGIC, struct.pack("<HQQ", len(widths), len(ids), len(doc_ids))], []
    body.append(np.array([d or 0 for d in doc_ids], "<i8").tobytes())
    body.append(np.array([d is None for d in doc_ids], np.uint8).tobytes())
    body.append(np.array(lengths, "<u4").tobytes())
    rest = ids.astype(np.uint32)
    for w in widths:
        head.append(struct.pack("<BQ", w, len(rest)))
        chunk, rest = rest & np.uint32((1 << w) - 1), rest >> np.uint32(w)
        for shift in range(0, w - 7, 8):
            body.append((chunk >> np.uint32(shift)).astype(np.uint8).tobytes())
        if w % 8:
            nibble = (chunk >> np.uint32(w - 4)).astype(np.uint8)
            nibble = np.append(nibble, np.zeros(len(nibble) % 2, np.uint8))
            body.append((nibble[::2] | nibble[1::2] << 4).tobytes())
        on = rest > 0
        bitmap = np.packbits(on, bitorder="little")
        body.append(bitmap.tobytes())
        per = np.add.reduceat(on, np.arange(0, len(on), BLOCK), dtype=np.int64) if len(on) else np.zeros(0, np.int64)
        body.append(np.concatenate(([0], np.cumsum(per)))[: len(per)].astype("<u4").tobytes())
        rest = rest[on]
    return b"".join(head + body)


class Shard:
    """A shard file in memory: random access by position and whole decoding."""

    def __init__(self, raw: bytes):
        if raw[:6] != MAGIC:
            raise ValueError("not a token-id shard")
        levels, self.size, docs = struct.unpack_from("<HQQ", raw, 6)
        at = 24
        shape = []
        for _ in range(levels):
            shape.append(struct.unpack_from("<BQ", raw, at))
            at += 9

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        keys, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else k for k, n in zip(keys.tolist(), null.tolist())]
        self.lengths = take("<u4", docs).astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.levels = []
        for w, n in shape:
            planes = [take("u1", n) for _ in range(w // 8)]
            nibbles = take("u1", (n + 1) // 2) if w % 8 else None
            bitmap = take("u1", (n + 7) // 8)
            self.levels.append((w, n, planes, nibbles, bitmap, take("<u4", (n + BLOCK - 1) // BLOCK)))

    def token(self, i: int) -> int:
        """The id at position i, from one chunk per level."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = shift = 0
        for w, _, planes, nibbles, bitmap, rank in self.levels:
            for k, plane in enumerate(planes):
                value |= int(plane[i]) << (shift + 8 * k)
            if nibbles is not None:
                value |= (int(nibbles[i >> 1]) >> (4 * (i & 1)) & 15) << (shift + w - 4)
            shift += w
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK * BLOCK
            before = np.unpackbits(bitmap[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first].sum()
            i = int(rank[i // BLOCK]) + int(before)
        return value

    def decode(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.size, np.uint32)
        who, shift = None, 0
        for w, n, planes, nibbles, bitmap, _ in self.levels:
            chunk = np.zeros(n, np.uint32)
            for k, plane in enumerate(planes):
                chunk |= plane.astype(np.uint32) << np.uint32(8 * k)
            if nibbles is not None:
                both = np.empty(2 * len(nibbles), np.uint8)
                both[::2], both[1::2] = nibbles & 15, nibbles >> 4
                chunk |= both[:n].astype(np.uint32) << np.uint32(w - 4)
            if who is None:
                out |= chunk
            else:
                out[who] |= chunk << np.uint32(shift)
            on = np.nonzero(np.unpackbits(bitmap, count=n, bitorder="little"))[0]
            who = on if who is None else who[on]
            shift += w
        return out


class Ranges(NamedTuple):
    """Key ranges: upper bounds (exclusive), the hash ranges each is divided into, and those of null keys (0: there are none)."""

    cuts: list[int]
    widths: list[int]
    nulls: int


def key_ranges(docs: DataFrame, key: str, wanted: int) -> Ranges:
    """About ``wanted`` ranges of like row counts; reads the key column only.

    A key that holds several ranges' rows is a range of its own and is divided by a hash of the text,
    and so are null keys, so neither meets in one task.
    """
    cuts = docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / wanted for i in range(1, wanted)], 0.2 / wanted)
    held = Counter(map(int, cuts))
    bounds = sorted({min(x, (1 << 63) - 1) for c, n in held.items() for x in ((c, c + 1) if n > 1 else (c + 1,))})
    widths = [held[z - 1] if held[z - 1] > 1 and a == z - 1 else 1 for a, z in zip([None, *bounds], bounds)] + [1]
    rows, known = docs.agg(F.count("*"), F.count(key)).first()
    return Ranges(bounds, widths, -(-wanted * (rows - known) // max(1, rows)))


def hash_share(text: Column) -> Column:
    """A hash of the text as a number from 0 to 1."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).cast("double") / F.lit(float(1 << 64)) + 0.5


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 1, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """Encode, order by key and write the shards; returns the shard table and each bucket's first position.

    Null text: only the end id. Null keys come last, after all others; rows of one key stay together
    (their order among each other is by ids; where one key or null holds more than a range, by hash
    ranges of the text first). Repeated rows are written each for itself; texts of any length; other
    columns are ignored, whatever their names. Empty table: no shards. The driver gets one number per
    key range.
    """
    path = path or tokenizer_path("word_bpe_49k.json")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    found = key_ranges(docs, key, 2 * parts)
    cuts, widths = np.array(found.cuts, np.int64), np.array([*found.widths, max(1, found.nulls)])
    starts = np.concatenate(([0], np.cumsum(widths)))

    def make():
        bpe = encoder(path, streaming=True)
        end = np.array([end_id], "<u4").tobytes()

        def step(keys, shares, texts):
            packed = bpe.encode_packed([t or "" for t in texts])
            coarse = [len(cuts) + 1 if k is None else int(np.searchsorted(cuts, k, "right")) for k in keys]
            small = [np.frombuffer(p + end, "<u4") for p in packed]
            return {
                "bucket": [int(starts[c] + min(int(s * widths[c]), widths[c] - 1)) for c, s in zip(coarse, shares)],
                "key": keys,
                "wide": [bool((s > 0xFFFF).any()) for s in small],
                "ids": [(s if (s > 0xFFFF).any() else s.astype("<u2")).tobytes() for s in small],
            }

        return step

    rows = arrow_map(docs.select(F.col(key).alias("key"), hash_share(F.col(text)).alias("share"), F.col(text).alias("text")), "bucket int, key bigint, wide boolean, ids binary", make)
    rows = rows.repartitionById(parts, "bucket").sortWithinPartitions("bucket", "key", "ids")

    def shards():
        state = {"bucket": None, "first": 0, "keys": [], "ids": [], "n": 0}
        out: list[tuple] = []

        def flush():
            if state["keys"]:
                ids = np.concatenate(state["ids"])
                out.append((state["bucket"], state["first"], len(ids), pack(state["keys"], [len(x) for x in state["ids"]], ids)))
                state.update(first=state["first"] + len(ids), keys=[], ids=[], n=0)

        def step(buckets, keys, wide, ids):
            for b, k, w, raw in zip(buckets, keys, wide, ids):
                if b != state["bucket"]:
                    flush()
                    state.update(bucket=b, first=0)
                one = np.frombuffer(raw, "<u4" if w else "<u2").astype(np.uint32)
                state["keys"].append(k)
                state["ids"].append(one)
                state["n"] += len(one)
                if state["n"] >= SHARD_IDS:
                    flush()
            return done()

        def done():
            made = {n: [r[i] for r in out] for i, n in enumerate(("bucket", "first", "n_ids", "payload"))}
            out.clear()
            return made

        def last():
            flush()
            return done()

        return step, last

    table = written(streamed(rows, "bucket int, first bigint, n_ids bigint, payload binary", shards), "token-shards")
    totals = {r["bucket"]: r["n"] for r in table.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect()}
    start, at = {}, 0
    for b in sorted(totals):
        start[b], at = at, at + totals[b]
    return table, start


def streamed(df: DataFrame, schema: str, make) -> DataFrame:
    """``mapInArrow`` whose state goes on over the batches of a partition: ``make() -> (step, last)``."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    fields = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        step, last = make()

        def batch(made):
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in fields], schema=fields)

        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                made = step(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                if made[fields[0].name]:
                    yield batch(made)
        made = last()
        if made[fields[0].name]:
            yield batch(made)

    return df.mapInArrow(run, schema)


def read_token_files(table: DataFrame, start: dict[int, int], key: str = "doc_id") -> DataFrame:
    """Per document of the shards: ``key, start, n_tokens, ids_crc32``.

    Null keys and repeated rows come back as they were written; an empty table of shards: no rows.
    """

    def make():
        def step(buckets, firsts, payloads):
            keys, starts, sizes, sums = [], [], [], []
            for b, first, raw in zip(buckets, firsts, payloads):
                shard = Shard(raw)
                ids = shard.decode().astype("<u4")
                at = shard.starts.tolist()
                keys += shard.doc_ids
                starts += [start[b] + first + a for a in at[:-1]]
                sizes += shard.lengths.tolist()
                sums += [zlib.crc32(ids[a:z].tobytes()) for a, z in zip(at, at[1:])]
            return {"key": keys, "start": starts, "n_tokens": sizes, "ids_crc32": sums}

        return step

    out = arrow_map(table.select("bucket", "first", "payload"), "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint", make)
    return out.withColumnRenamed("key", key)
