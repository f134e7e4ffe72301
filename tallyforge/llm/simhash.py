"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint maps to the bit counts of its 16 four-bit segments. Flipping a bit moves one
count by one, so the Manhattan distance of two count vectors is at most the Hamming distance of the
fingerprints. Vectors are points of an integer grid, and two points at Manhattan distance two or
less share a grid point within distance one of both that lies between them. Of three blocks of
segments, one is equal in fingerprints two bits apart, so a cell is such a grid point of the other
segments beside the bits of that block. Every *distinct* fingerprint enters the cells of its own
vector and of the neighbours one step away, some 60 in all; cells meet in sorted partitions, and XOR
plus a bit count verifies the pairs. A random pair shares a cell with probability below 1e-9.

Copies never meet: they are one fingerprint. A cell with over ``CROWD`` fingerprints is not paired;
its members go through points one bit flip away instead, of which no two fingerprints within two
bits lack a common one and none has over 65 members. So work grows with fingerprints and links only.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import arrow_map, fresh, hex64, lookup, release, shuffle_partitions, written
from tallyforge.llm.components import components

SEGMENTS, BITS = 16, 4
#: Segments of the three blocks, from the low end.
BLOCKS = ((0, 5), (5, 10), (10, 16))
#: Fingerprints of a cell that are compared pair by pair at most; fuller cells go through bit flips.
CROWD = 256


def fingerprint(words: list[bytes], size: int = 3, seed: int = 42) -> int:
    """SimHash of word shingles, repeats included: bit set if set in over half the hashes."""
    import xxhash

    if not words:
        return 0
    h = partial(xxhash.xxh64_intdigest, seed=seed)
    if len(words) <= size:
        return h(b" ".join(words))
    ones, n = np.zeros(64, np.int64), len(words) - size + 1
    for at in range(0, n, 65_536):
        part = words[at : at + 65_536 + size - 1]
        count = len(part) - size + 1
        a = np.fromiter(map(h, map(b" ".join, zip(*(part[i:] for i in range(size))))), np.uint64, count)
        ones += np.unpackbits(a.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp`` (signed 64-bit) and ``h``, a hash of the text itself.

    A-Z are lower-cased, words are runs outside space and \\x09-\\x0D; null or blank text: 0.
    """

    def make():
        release()

        def step(keys, hashes, texts):
            made = [fingerprint((t or "").encode().lower().split(), size, seed) for t in texts]
            return {"key": keys, "h": hashes, "fp": np.array(made, np.uint64).astype(np.int64).tolist() if made else []}

        return step

    return arrow_map(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.col(text).alias("text")), "key bigint, h bigint, fp bigint", make)


def cells(fps: DataFrame) -> DataFrame:
    """``cell, fp``: for each block, its bits beside the count vector of the others (three bits a count) and each valid neighbour."""

    def make():
        def step(values):
            fp = np.array(values, np.int64)
            bits = fp.view(np.uint64)
            count = np.bitwise_count(bits[:, None] >> np.arange(0, 64, BITS, dtype=np.uint64) & np.uint64(15)).astype(np.int64)
            cell, who = [], []
            for k, (low, high) in enumerate(BLOCKS):
                rest = [s for s in range(SEGMENTS) if not low <= s < high]
                place = np.int64(1) << (3 * np.arange(len(rest), dtype=np.int64))
                same = (bits >> np.uint64(BITS * low) & np.uint64((1 << BITS * (high - low)) - 1)).astype(np.int64)
                own = (np.int64(k) << np.int64(61)) + (same << np.int64(3 * len(rest))) + (count[:, rest] * place).sum(1)
                up, down = count[:, rest] < BITS, count[:, rest] > 0
                cell += [own, (own[:, None] + place)[up], (own[:, None] - place)[down]]
                who += [fp, np.repeat(fp, up.sum(1)), np.repeat(fp, down.sum(1))]
            return {"cell": pa.array(np.concatenate(cell)), "fp": pa.array(np.concatenate(who))}

        return step

    return arrow_map(fps.select("fp"), "cell bigint, fp bigint", make)


def flips(fps: DataFrame) -> DataFrame:
    """``cell, fp``: each fingerprint at itself and at every value one bit away."""

    def make():
        def step(values):
            fp = np.array(values, np.int64)
            masks = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64).view(np.int64)
            return {"cell": pa.array((fp[:, None] ^ masks).ravel()), "fp": pa.array(np.repeat(fp, 65))}

        return step

    return arrow_map(fps.select("fp"), "cell bigint, fp bigint", make)


def met(put: DataFrame, distance: int, crowd: int) -> DataFrame:
    """``a, b``: pairs ``a < b`` within ``distance`` that share a cell, and members of cells over ``crowd`` with a null ``b``.

    One shuffle by cell; a partition streams through in order, holding one batch and at most
    ``crowd`` members of a cell.
    """
    rows = put.repartition(shuffle_partitions(put.sparkSession), "cell").sortWithinPartitions("cell")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def paired(cell, fp):
        """Pairs of whole groups of one cell each, and members of crowds."""
        edge = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        size = np.diff(np.concatenate(([0], edge, [len(cell)])))
        size = np.repeat(size, size)
        yield None, fp[size > crowd]
        some = (size > 1) & (size <= crowd)
        cell, fp = cell[some], fp[some]
        at, step = np.arange(len(cell)), 1
        while len(at):
            at = at[at + step < len(cell)]
            at = at[cell[at] == cell[at + step]]
            x, y = fp[at], fp[at + step]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= distance
            x, y = x[near], y[near]
            yield np.minimum(x, y), np.maximum(x, y)
            step += 1

    def run(batches):
        cell, fp, full = np.zeros(0, np.int64), np.zeros(0, np.int64), None

        def batch(a, b):
            if a is None:
                return pa.RecordBatch.from_arrays([pa.array(b), pa.nulls(len(b), pa.int64())], schema=out)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)

        for part in batches:
            cell, fp = np.concatenate((cell, part.column(0).to_numpy())), np.concatenate((fp, part.column(1).to_numpy()))
            if full is not None and len(cell):  # goes on from the batch before
                n = int(np.searchsorted(cell, full, "right"))
                if n:
                    yield batch(None, fp[:n])
                cell, fp = cell[n:], fp[n:]
                if len(cell):
                    full = None
            if not len(cell):
                continue
            last = int(np.searchsorted(cell, cell[-1], "left"))
            for a, b in paired(cell[:last], fp[:last]):
                if len(b):
                    yield batch(a, b)
            cell, fp = cell[last:], fp[last:]
            if len(cell) > crowd:
                yield batch(None, fp)
                full, cell, fp = cell[0], cell[:0], fp[:0]
        for a, b in paired(cell, fp):
            if len(b):
                yield batch(a, b)

    return rows.mapInArrow(run, "a bigint, b bigint")


def links(fps: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints at ``distance`` (up to 2) or fewer bits; all of them."""
    if not 0 <= distance <= 2:
        raise ValueError("cells one step around each vector cover distances up to 2")
    found = written(met(cells(fps), distance, crowd), "pairs")
    pairs, crowded = found.where("b is not null"), found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if not crowded.isEmpty():
        pairs = pairs.union(met(flips(crowded), distance, 65))
    return pairs.distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, size: int = 3, seed: int = 42, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, fp, component_id``: the smallest key reachable over links of fingerprints.

    Null keys stay in the result and count as larger than any key; a component of null keys only
    has a null id. Repeated rows come out repeated. Empty table: no rows.
    """
    rows = written(fingerprints(docs, size, seed, text, key), "fingerprints")
    found = written(groups(rows, distance), "groups")
    return attach(rows, found).select(F.col("key").alias(key), "fp", "component_id")


def attach(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the group of their fingerprint; a fingerprint may hold a third of all rows."""
    total = found.agg(F.sum("n")).first()[0] or 0
    return lookup(rows, found, "fp", total / (4 * shuffle_partitions(rows.sparkSession)))


def least_by_fingerprint(rows: DataFrame, least, name: str, *more) -> DataFrame:
    """Grouped minimum of each fingerprint in two steps, so that not even the map tasks' minima of a hot one meet in one task."""
    salt = F.pmod(F.spark_partition_id(), F.lit(32)).alias("salt")
    counted = rows.groupBy("fp", salt).agg(F.min(least).alias(name), F.count("*").alias("n"))
    return counted.groupBy("fp").agg(F.min(name).alias(name), F.sum("n").alias("n"), *more)


def groups(rows: DataFrame, distance: int = 2) -> DataFrame:
    """``fp, n, root, component_id`` of each distinct fingerprint of ``rows``; ``root`` numbers the group, ``n`` counts the rows."""
    reps = written(least_by_fingerprint(rows, F.col("key"), "first"), "representatives")
    parts = shuffle_partitions(rows.sparkSession)
    linked = components(links(reps.select("fp").repartition(parts), distance))
    by = written(linked.join(reps, linked.node == reps.fp).select("fp", "root", "first"), "linked")
    lowest = by.groupBy("root").agg(F.min("first").alias("low"), F.count("*").alias("members"))
    lows = lookup(by, lowest, "root", by.count() / (4 * parts), "members").select("fp", "root", "low")
    joined = reps.join(lows, "fp", "left")
    return joined.select("fp", "n", F.coalesce("root", "fp").alias("root"), F.coalesce("low", "first").alias("component_id"))


def deduplicated(docs: DataFrame, distance: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group, with all its columns: that with the smallest key (nulls last, then by text hash).

    Of repeated rows one stays; null, empty and blank texts are one group. Columns of any name come
    back as they are. Empty table: no rows.
    """
    rows = written(fingerprints(docs, text=text, key=key), "fingerprints")
    least = F.struct(F.col("key").isNull().alias("no_key"), "key", "h")
    own = least_by_fingerprint(rows, least, "m").drop("n")
    stays = own.join(groups(rows, distance), "fp").groupBy("root").agg(F.min("m").alias("m"))
    # null keys join like any other; the window below needs no further exchange
    *names, copy = fresh(docs.columns, "key_or_zero", "no_key", "text_hash", "copy")
    stays = stays.select(F.coalesce("m.key", F.lit(0)).alias(names[0]), F.col("m.no_key").alias(names[1]), F.col("m.h").alias(names[2]))
    held = docs.withColumns({names[0]: F.coalesce(F.col(key), F.lit(0)), names[1]: F.col(key).isNull(), names[2]: F.xxhash64(text)})
    first = F.row_number().over(Window.partitionBy(*names).orderBy(names[0]))
    return held.join(stays, names, "left_semi").withColumn(copy, first).where(F.col(copy) == 1).select(*docs.columns)


def near_duplicate_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``near_duplicates`` with the fingerprint as 16 hex digits; the same results for nulls, ties, repeated rows and the empty table."""
    out = near_duplicates(docs, text=text, key=key)
    return out.select(key, hex64(F.col("fp")).alias("fingerprint"), "component_id")
