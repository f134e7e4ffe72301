"""Small decision trees: growth on binned features, forests, gradient boosting, and SQL text of a forest."""

from __future__ import annotations

import numpy as np

BINS = 24


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Candidate thresholds per feature: midpoints between neighbouring quantiles."""
    out = []
    for col in x.T:
        values = np.unique(col)
        if len(values) > BINS:
            values = np.unique(np.quantile(col, np.linspace(0, 1, BINS)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


class Binned:
    """Features as bin numbers, so that a node's gains over all thresholds come from three counts."""

    def __init__(self, x: np.ndarray):
        self.cuts = cuts_of(x)
        self.n = max((len(c) for c in self.cuts), default=0) + 1
        cols = [np.searchsorted(c, col, "left") for c, col in zip(self.cuts, x.T)]
        self.at = np.stack(cols, 1) + np.arange(len(cols)) * self.n if cols else np.zeros((len(x), 0), np.int64)


def grow(x: Binned, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, columns=None, ridge: float = 1.0):
    """A tree as ``(feature, threshold, low side, high side)`` or a leaf value G/(H+ridge)."""
    g, h = grad[rows], hess[rows]
    value = float(g.sum() / (h.sum() + ridge))
    if depth == 0 or len(rows) < 2 * least:
        return value
    at = x.at[rows]
    k = at.shape[1]
    count = lambda w: np.cumsum(np.bincount(at.ravel(), None if w is None else np.repeat(w, k), k * x.n).reshape(k, x.n), 1)
    n, gs, hs = count(None), count(g), count(h)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gs**2 / (hs + ridge) + (g.sum() - gs) ** 2 / (h.sum() - hs + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(n < least) | (len(rows) - n < least)] = -1
    if columns is not None:
        shut = np.ones(k, bool)
        shut[columns()] = False
        gain[shut] = -1
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, b] <= 1e-6:
        return value
    low = at[:, f] <= f * x.n + b
    f, cut = int(f), float(x.cuts[f][b])
    return (f, cut, grow(x, rows[low], grad, hess, depth - 1, least, columns, ridge), grow(x, rows[~low], grad, hess, depth - 1, least, columns, ridge))


def walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, c, low, high = tree
    out, side = np.empty(len(x)), x[:, f] <= c
    out[side], out[~side] = walk(low, x[side]), walk(high, x[~side])
    return out


def forest(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 5, seed: int = 7) -> list:
    """Random forest: bootstrap rows, a square root of the features per split, leaves hold the share of y."""
    rng = np.random.default_rng(seed)
    binned, k = Binned(x), max(2, int(x.shape[1] ** 0.5) + 1)
    ones = np.ones(len(x))
    return [grow(binned, rng.integers(0, len(x), len(x)), y.astype(float), ones, depth, 3, lambda: rng.choice(x.shape[1], k, replace=False), 1e-9) for _ in range(trees)]


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25) -> list:
    """Gradient-boosted trees for the log-odds of y."""
    below, score, out = Below(x), np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree, fitted = grow_levels(below, y - p, p * (1 - p), depth, 8)
        score += rate * fitted
        out.append(scaled(tree, rate))
    return out


class Below:
    """For every candidate threshold, whether each row lies at or below it: sums of a level are one product."""

    def __init__(self, x: np.ndarray):
        self.cuts = [(f, float(c)) for f, cs in enumerate(cuts_of(x)) for c in cs]
        self.side = np.array([x[:, f] <= c for f, c in self.cuts]).reshape(len(self.cuts), len(x))
        self.sums = self.side.astype(np.float32)


def grow_levels(x: Below, grad: np.ndarray, hess: np.ndarray, depth: int, least: int, ridge: float = 1.0):
    """The tree that ``grow`` makes, level by level, and each row's leaf value."""
    fitted = np.zeros(len(grad))
    at = np.zeros(len(grad), np.int64)  # each row's node; nodes are numbered as in a heap
    made: dict[int, tuple[int, float]] = {}
    value: dict[int, float] = {}
    for level in range(depth + 1):
        first = 2**level - 1
        rows = np.nonzero(at >= first)[0]
        nodes = np.unique(at[rows])
        if not len(nodes):
            break
        own, k = np.searchsorted(nodes, at[rows]), len(nodes)
        weights = (grad[rows], hess[rows], np.ones(len(rows)))
        g, h, n = (np.bincount(own, w, k) for w in weights)
        mean = g / (h + ridge)
        value.update(zip(nodes.tolist(), mean.tolist()))
        fitted[rows] = mean[own]
        if level == depth or not x.cuts:
            break
        parts = np.zeros((len(grad), 3 * k), np.float32)
        for i, w in enumerate(weights):
            parts[rows, i * k + own] = w
        sums = (x.sums @ parts).astype(np.float64)
        gs, hs, ns = (sums[:, i * k : i * k + k] for i in range(3))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
        gain[(ns < least) | (n - ns < least)] = -1
        best = gain.argmax(0)
        split = (gain[best, np.arange(k)] > 1e-6) & (n >= 2 * least)
        for j in np.nonzero(split)[0]:
            made[int(nodes[j])] = x.cuts[best[j]]
        low = x.side[best[own], rows]
        at[rows] = np.where(split[own], 2 * at[rows] + np.where(low, 1, 2), -1)

    def tree(node: int):
        return (*made[node], tree(2 * node + 1), tree(2 * node + 2)) if node in made else value[node]

    return tree(0), fitted


def scaled(tree, rate: float):
    return (tree[0], tree[1], scaled(tree[2], rate), scaled(tree[3], rate)) if isinstance(tree, tuple) else tree * rate


def sql(tree, names: list[str]) -> str:
    """The tree as nested CASE expressions over columns or struct fields."""
    if not isinstance(tree, tuple):
        return f"{tree:.6f}D"
    f, c, low, high = tree
    return f"CASE WHEN {names[f]} <= {c!r}D THEN {sql(low, names)} ELSE {sql(high, names)} END"


class Flat:
    """Trees as arrays of complete binary trees, so that a batch goes down all levels at once."""

    def __init__(self, trees: list, depth: int):
        size = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.zeros((len(trees), size), np.int64)
        self.cut = np.full((len(trees), size), np.inf)
        self.leaf = np.zeros((len(trees), size))
        for t, tree in enumerate(trees):
            self._put(t, 0, tree)

    def _put(self, t: int, at: int, tree):
        if isinstance(tree, tuple):
            self.feature[t, at], self.cut[t, at] = tree[0], tree[1]
            self._put(t, 2 * at + 1, tree[2])
            self._put(t, 2 * at + 2, tree[3])
            return
        while 2 * at + 1 < self.leaf.shape[1]:  # a leaf higher up: go down its low side
            at = 2 * at + 1
        self.leaf[t, at] = tree

    def score(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at]
        return out
