"""Gradient boosted trees: histograms, leaf-wise growth, early stopping.

Gradients are whole numbers of 2^-30, so that sums over rows are exact in any
order, and a tree follows from sums alone.  ``BoostedTrees.fit`` adds them up
over arrays, for a table that fits one task; ``boosting_sums`` adds them up as
an aggregation over any table, and grows the same trees.  A model is a flat list
of arrays, so it travels as bytes.
"""

from __future__ import annotations

import pickle

import numpy as np

UNIT = float(1 << 30)


def rank_auc(y: np.ndarray, score: np.ndarray) -> float:
    """Area under the ROC curve by mean ranks; 0.5 with one class."""
    ones = int(y.sum())
    if not 0 < ones < len(y):
        return 0.5
    _, at, counts = np.unique(score, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[at]
    return float((ranks[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones)))


def slopes(raw: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(rows, 3): gradient and curvature of the log loss in whole numbers, and one for the count."""
    p = 1 / (1 + np.exp(-raw))
    return np.stack([np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT), np.ones(len(y))], axis=1)


def drawn(ids: np.ndarray, draw: int, share: float) -> np.ndarray:
    """Which rows a draw takes: a mixed hash of the row's number and the draw's, so it doesn't depend on where rows lie."""
    z = ids.astype(np.int64).view(np.uint64) + np.uint64((draw + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(11) < np.uint64(round(share * (1 << 53)))


def sums_by_bin(b: np.ndarray, slope: np.ndarray, features, bins: int) -> np.ndarray:
    """(all features, bins, 3): sums of the slopes of rows in each bin of ``features``; zeros for the other features."""
    out = np.zeros((b.shape[1], bins, 3), dtype=np.int64)
    gradient, curvature = np.ascontiguousarray(slope[:, 0]), np.ascontiguousarray(slope[:, 1])
    for f in features:
        column = b[:, f].astype(np.intp)
        out[f, :, 0], out[f, :, 1] = np.bincount(column, gradient, bins), np.bincount(column, curvature, bins)
        out[f, :, 2] = np.bincount(column, minlength=bins)
    return out


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    if not len(cuts):
        return np.zeros((len(x), 0), dtype=np.uint16)
    return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype(np.uint16)


def places(tree, b: np.ndarray) -> np.ndarray:
    """The node of a flat tree where each row ends."""
    feature, cut, left, right = tree[:4]
    at = np.zeros(len(b), dtype=np.int64)
    while True:
        inner = np.flatnonzero(feature[at] >= 0)
        if not len(inner):
            return at
        node = at[inner]
        at[inner] = np.where(b[inner, feature[node]] <= cut[node], left[node], right[node])


def outputs(tree, b: np.ndarray) -> np.ndarray:
    return tree[4][places(tree, b)]


class Growth:
    """A tree in the making: the leaf that gains most is split next.

    Nodes are numbered as in a heap, from 1.  The sums of a node's lower child
    are given from outside, those of the other are the difference.  Children may
    be known before it is: what the tree takes of them doesn't depend on when.
    """

    def __init__(self, learner: BoostedTrees, features: np.ndarray, root: np.ndarray):
        self.learner, self.features = learner, features
        self.sums, self.cuts = {}, {}
        self._add(1, root)

    def _add(self, node: int, sums: np.ndarray) -> None:
        """The best (gain, feature, bin) to cut a node at; no feature where none gains."""
        how, best = self.learner, (0.0, -1, -1)
        g, h, n = sums[self.features[0]].sum(axis=0)
        l2 = how.l2
        for f in self.features:
            m = len(how.cuts[f]) + 1
            if m < 2:
                continue
            gl, hl, nl = np.cumsum(sums[f, : m - 1], axis=0).T
            low, high, whole = (gl / UNIT) ** 2 / (hl / UNIT + l2), ((g - gl) / UNIT) ** 2 / ((h - hl) / UNIT + l2), (g / UNIT) ** 2 / (h / UNIT + l2)
            gain = np.where((nl < how.least_rows) | (n - nl < how.least_rows), 0.0, low + high - whole)
            k = int(gain.argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), int(f), k)
        self.sums[node], self.cuts[node] = sums, best

    def _frontier(self) -> tuple[list[int], bool]:
        """Leaves as far as the tree is known, and whether that is all of it."""
        leaves = [1]
        while len(leaves) < self.learner.leaves:
            node = min(leaves, key=lambda n: (-self.cuts[n][0], n))
            if self.cuts[node][1] < 0:
                return leaves, True
            if 2 * node not in self.cuts:
                return leaves, False
            leaves.remove(node)
            leaves += [2 * node, 2 * node + 1]
        return leaves, True

    def wanted(self) -> list[int]:
        """Leaves that the tree may cut next, the surest first; none when it is grown."""
        leaves, done = self._frontier()
        if done:
            return []
        unknown = sorted((n for n in leaves if self.cuts[n][1] >= 0 and 2 * n not in self.cuts), key=lambda n: (-self.cuts[n][0], n))
        return unknown[: self.learner.leaves - len(leaves)]

    def give(self, node: int, low: np.ndarray) -> None:
        self._add(2 * node, low)
        self._add(2 * node + 1, self.sums[node] - low)

    def flat(self):
        """Arrays (feature, bin, left, right, value), the heap number of each node, and the gain by feature."""
        leaves, _ = self._frontier()
        ends, numbers, gains = set(leaves), [1], np.zeros(len(self.learner.cuts))
        feature, cut, left, right, value = [], [], [], [], []
        for node in numbers:  # grows while it is walked
            gain, f, k = self.cuts[node]
            inner = node not in ends
            feature.append(f if inner else -1)
            cut.append(k if inner else 0)
            left.append(len(numbers) if inner else 0)
            right.append(len(numbers) + 1 if inner else 0)
            g, h, _ = self.sums[node][self.features[0]].sum(axis=0)
            value.append(0.0 if inner else float(-self.learner.rate * (g / UNIT) / (h / UNIT + self.learner.l2)))
            if inner:
                gains[f] += gain
                numbers += [2 * node, 2 * node + 1]
        return tuple(np.array(c) for c in (feature, cut, left, right, value)), numbers, gains


class BoostedTrees:
    def __init__(self, rounds=2000, patience=100, rate=0.03, leaves=15, least_rows=10, l2=1.0, feature_share=0.85, row_share=0.85, draw_every=5, bins=255, seed=42):
        self.rounds, self.patience, self.rate, self.leaves, self.least_rows, self.l2 = rounds, patience, rate, leaves, least_rows, l2
        self.feature_share, self.row_share, self.draw_every, self.bins, self.seed = feature_share, row_share, draw_every, bins, seed
        self.trees: list[tuple[np.ndarray, ...]] = []
        self.start, self.cuts, self.gains = 0.0, [], np.zeros(0)

    def begin(self, ones: float, rows: int, cuts: list[np.ndarray]) -> bool:
        """Set cuts and the starting score; False where there is nothing to tell apart."""
        mean = (ones + 1e-9) / max(1e-9, rows + 2e-9)
        self.start, self.cuts = float(np.log(mean / (1 - mean))), cuts
        self.gains, self._each = np.zeros(len(cuts)), []
        self._best, self._kept, self._random = -1.0, 0, np.random.default_rng(self.seed)
        return 0 < ones < rows

    def features(self) -> np.ndarray:
        """The features of the next tree."""
        width = len(self.cuts)
        return np.sort(self._random.choice(width, max(1, round(self.feature_share * width)), replace=False))

    def keep(self, tree, gains: np.ndarray) -> None:
        self.trees.append(tree)
        self._each.append(gains)

    def judge(self, step: int, score: float) -> bool:
        """Note the held-out score after a round; True when it hasn't risen for ``patience`` rounds."""
        if score > self._best + 1e-12:
            self._best, self._kept = score, step + 1
        return step + 1 - self._kept >= self.patience

    def end(self) -> BoostedTrees:
        """Go back to the best round."""
        del self.trees[self._kept :], self._each[self._kept :]
        for gains in self._each:
            self.gains = self.gains + gains
        self._each, self._random = [], None
        return self

    def fit(self, x, y, x_valid, y_valid, ids=None, cuts=None) -> BoostedTrees:
        """``ids`` decide which rows a draw takes (a random choice of positions if not given); ``cuts`` are those of the features (quantiles of ``x`` if not given)."""
        if cuts is None:
            cuts = [np.unique(np.quantile(x[:, i], np.arange(1, self.bins) / self.bins, method="lower")) if len(x) else np.zeros(0) for i in range(x.shape[1])]
            cuts = [c[:-1] if len(c) and len(x) and c[-1] >= x[:, i].max() else c for i, c in enumerate(cuts)]
        return self.fit_bins(binned(x, cuts), y, binned(x_valid, cuts), y_valid, ids, cuts)

    def fit_bins(self, b, y, bv, y_valid, ids, cuts) -> BoostedTrees:
        """``fit`` of features that are in bins already."""
        if not self.begin(y.sum(), len(y), cuts):
            return self
        raw, raw_v = np.full(len(y), self.start), np.full(len(y_valid), self.start)
        for step in range(self.rounds):
            if step % self.draw_every == 0:
                if ids is None:
                    own = np.sort(self._random.choice(len(y), max(1, round(self.row_share * len(y))), replace=False))
                else:
                    own = drawn(ids, step // self.draw_every, self.row_share)
                bo = b[own]
            features, slope = self.features(), slopes(raw[own], y[own])
            tree = Growth(self, features, sums_by_bin(bo, slope, features, self.bins))
            rows = {1: np.arange(len(bo))}
            while ahead := tree.wanted():
                node = ahead[0]
                _, f, k = tree.cuts[node]
                low = bo[rows[node], f] <= k
                rows[2 * node], rows[2 * node + 1] = rows[node][low], rows[node][~low]
                # the smaller side is summed; sums are whole numbers, so the other is the exact difference
                smaller = min(rows[2 * node], rows[2 * node + 1], key=len)
                sums = sums_by_bin(bo[smaller], slope[smaller], features, self.bins)
                tree.give(node, sums if smaller is rows[2 * node] else tree.sums[node] - sums)
            made, _, gains = tree.flat()
            self.keep(made, gains)
            raw += outputs(made, b)
            raw_v += outputs(made, bv)
            if self.judge(step, rank_auc(y_valid, raw_v)):
                break
        return self.end()

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.start)
        if self.trees:
            b = binned(x, self.cuts)
            for tree in self.trees:
                raw += outputs(tree, b)
        return 1 / (1 + np.exp(-raw))

    def dump(self) -> bytes:
        return pickle.dumps(self)
