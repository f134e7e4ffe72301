"""Item matching: candidate pairs by a theta join inside each receipt, then one-to-one assignment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.config import Evaluation
from tallyforge.functions import text as T


def candidate_pairs(pred: DataFrame, truth: DataFrame, key: str = "receipt_id", config: Evaluation = Evaluation()) -> DataFrame:
    """Pairs of ``(key, pos, name, price)`` items whose names are alike and whose prices agree.

    Equi-join on the receipt; the cheap price test comes before the edit distance, which itself
    stops at the largest distance that could still pass.
    """
    name = T.evaluation_text(F.col("name"))
    p = pred.select(key, F.col("pos").alias("pred_pos"), name.alias("__p"), F.col("price").alias("__pp"))
    t = truth.select(key, F.col("pos").alias("truth_pos"), name.alias("__t"), F.col("price").alias("__tp"))
    priced = F.col("__tp").isNull() | (F.abs(F.col("__pp").cast("decimal(38,4)") - F.col("__tp").cast("decimal(38,4)")) <= config.price_tolerance)
    least = config.name_similarity
    pairs = p.join(t, key).where(priced).withColumn("similarity", T.similarity(F.col("__p"), F.col("__t"), least)).where(F.col("similarity") >= least)
    return pairs.select(key, "pred_pos", "truth_pos", F.round("similarity", 6).alias("similarity"))


def assign(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Max-weight one-to-one assignment of rows to columns (weights 0: not allowed), by augmenting paths."""
    n, m = len(weights), max((len(r) for r in weights), default=0)
    if not n or not m:
        return []
    size = max(n, m)
    cost = [[-(weights[i][j] if i < n and j < m else 0.0) for j in range(size)] for i in range(size)]
    u, v, owner, way = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        owner[0], j0 = i, 0
        least, used = [float("inf")] * (size + 1), [False] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, size + 1):
                if not used[j]:
                    cur = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    return sorted((owner[j] - 1, j - 1) for j in range(1, size + 1) if owner[j] - 1 < n and j - 1 < m and weights[owner[j] - 1][j - 1] > 0)


def greedy(pairs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Best pairs first, ties by prediction then truth place."""
    left, right, out = set(), set(), []
    for _, i, j in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            out.append((i, j))
    return sorted(out)


def matches(pairs: DataFrame, key: str = "receipt_id", method: str = "optimal") -> DataFrame:
    """One-to-one matches of the candidate pairs.

    A pair whose two items have no other candidate is a match as it stands; only the rest, sorted by
    receipt in its partition, streams through the assignment one receipt at a time.
    """
    pred, truth = F.count("*").over(Window.partitionBy(key, "pred_pos")), F.count("*").over(Window.partitionBy(key, "truth_pos"))
    pairs = pairs.repartition(key).withColumn("__p", pred).withColumn("__t", truth)
    plain, open_ = (F.col("__p") == 1) & (F.col("__t") == 1), (F.col("__p") > 1) | (F.col("__t") > 1)
    columns = [key, "pred_pos", "truth_pos", "similarity"]

    def one(group: list[tuple]) -> list[tuple]:
        rows, cols = sorted({g[1] for g in group}), sorted({g[2] for g in group})
        at_r, at_c = {p: i for i, p in enumerate(rows)}, {p: i for i, p in enumerate(cols)}
        if method == "greedy":
            made = greedy([(s, at_r[p], at_c[t]) for _, p, t, s in group])
        else:
            w = [[0.0] * len(cols) for _ in rows]
            for _, p, t, s in group:
                w[at_r[p]][at_c[t]] = max(w[at_r[p]][at_c[t]], s + 0.01)
            made = assign(w)
        return [(group[0][0], rows[i], cols[j]) for i, j in made]

    def run(frames):
        group: list[tuple] = []
        for frame in frames:
            out = []
            for row in zip(*(frame[c].tolist() for c in columns)):
                if group and group[0][0] != row[0]:
                    out += one(group)
                    group = []
                group.append(row)
            yield pd.DataFrame(out, columns=columns[:3])
        yield pd.DataFrame(one(group) if group else [], columns=columns[:3])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    rest = pairs.where(open_).select(columns).sortWithinPartitions(key).mapInPandas(run, f"{key} {kinds[key]}, pred_pos {kinds['pred_pos']}, truth_pos {kinds['truth_pos']}")
    return pairs.where(plain).select(columns[:3]).unionAll(rest)
