"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a document is cut into bins at quantiles of the training rows.
Boosting goes round the features in turn: a tree of depth two on one feature
alone is fitted to the gradient of the logistic loss and added, shrunk, to that
feature's table of bin values.  When the single tables are done, the pairs of
features whose joint cuts would still lower the loss most get two-dimensional
tables, boosted in turn in the same way.  A score is the logistic function of an
intercept plus one table entry for each feature and each pair, so whole batches
are scored by adding table look-ups.

Features are shares and means over the whole text; labels, language, source and
id are none of them.  At most about ``most_rows`` labelled rows, chosen by hash
of the id outside the held-out third, are learned from; the texts are read
once, for their features.

Rows: null and empty texts have features like any other (zero words) and a
score; a null id isn't held out and has no label; rows without a label, or with
a null one, aren't learned from; repeated
rows are rows like others, and an id with several labels counts for each; with
no labelled rows every score is 0.5; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import crc_mod, cut, utf8

FEATURES = (
    "log_words", "word_length", "distinct_words", "symbols", "bars", "upper", "digits", "shouts",
    "stops", "commas", "line_words", "repeated_lines", "non_ascii", "most_common", "space",
)


def _mask(characters: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(characters)).astype(np.float64)


_CLASSES = np.stack(
    [
        _mask(b"#*$%&<>"), _mask(b"|"), _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58))), _mask(b"!"),
        _mask(b".?"), _mask(b","), _mask(bytes(range(128, 256))), _mask(b" \t\n\r\x0b\x0c"),
    ],
    axis=1,
)


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    symbols, bars, upper, digits, shouts, stops, commas, high, space = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES
    words = raw.split()
    n = max(1, len(words))
    size = max(1, len(raw))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    tally = Counter(words)
    common = max(tally.values(), default=0) / n
    return [
        np.log1p(len(words)), (size - space) / n, len(tally) / n**0.9, symbols / size, bars / size, upper / size, digits / size, shouts / n,
        stops / n, commas / n, np.log1p(len(words) / max(1, len(lines))), (len(lines) - len(set(lines))) / max(1, len(lines)), high / size, common, space / size,
    ]


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of every row, x an array of the features in order."""

    def run(batches):
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col).cast("string")).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, x array<double>")


class AdditiveModel:
    def __init__(self, bins: int = 32, rounds: int = 60, pair_rounds: int = 30, pairs: int = 6, rate: float = 0.15, least: float = 3.0, ridge: float = 1.0):
        self.bins, self.rounds, self.pair_rounds, self.n_pairs = bins, rounds, pair_rounds, pairs
        self.rate, self.least, self.ridge = rate, least, ridge
        self.cuts: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        self.intercept = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(x, nan=0.0, posinf=1e300, neginf=-1e300)
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def _best_cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """Gain and place of the best split of bins whose gradients and weights are given."""
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - g.sum() ** 2 / (h.sum() + self.ridge)
        gain[(hl < self.least / 4) | (hr < self.least / 4)] = -np.inf
        k = int(gain.argmax()) if len(gain) else -1
        return (float(gain[k]), k + 1) if k >= 0 and np.isfinite(gain[k]) else (0.0, 0)

    def _tree(self, g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
        """Values of a tree over the bins of one feature."""
        if depth:
            gain, k = self._best_cut(g, h)
            if gain > 1e-9:
                return np.concatenate([self._tree(g[:k], h[:k], depth - 1), self._tree(g[k:], h[k:], depth - 1)])
        return np.full(len(g), -g.sum() / (h.sum() + self.ridge))

    def _pair_tree(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """Gain and values of one cut along each of two features."""
        best = (0.0, np.zeros_like(g))
        g2, h2 = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        if g.shape[0] < 2 or g.shape[1] < 2:
            return best
        a_g, a_h = g2[:-1, :-1], h2[:-1, :-1]
        row_g, row_h, col_g, col_h = g2[:-1, -1:], h2[:-1, -1:], g2[-1:, :-1], h2[-1:, :-1]
        quarters = [
            (a_g, a_h), (row_g - a_g, row_h - a_h), (col_g - a_g, col_h - a_h), (g2[-1, -1] - row_g - col_g + a_g, h2[-1, -1] - row_h - col_h + a_h),
        ]
        gain = sum(x**2 / (y + self.ridge) for x, y in quarters) - g2[-1, -1] ** 2 / (h2[-1, -1] + self.ridge)
        i, j = np.unravel_index(int(gain.argmax()), gain.shape)
        values = [-x[i, j] / (y[i, j] + self.ridge) for x, y in quarters]
        out = np.empty_like(g)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
        return float(gain[i, j]), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        if not len(y):
            return self
        self.cuts = [np.unique(np.quantile(x[:, i], np.arange(1, self.bins) / self.bins)) for i in range(x.shape[1])]
        b = self.binned(x)
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.intercept = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.intercept)

        def slopes():
            p = 1 / (1 + np.exp(-raw))
            return p - y, p * (1 - p)

        for _ in range(self.rounds):
            for i, table in enumerate(self.tables):
                g, h = slopes()
                step = self.rate * self._tree(np.bincount(b[:, i], g, len(table)), np.bincount(b[:, i], h, len(table)))
                table += step
                raw += step[b[:, i]]
        shape = lambda i, j: (len(self.tables[i]), len(self.tables[j]))
        flat = lambda i, j: b[:, i] * len(self.tables[j]) + b[:, j]
        sums = lambda i, j, v: np.bincount(flat(i, j), v, np.prod(shape(i, j))).reshape(shape(i, j))
        g, h = slopes()
        gains = [(self._pair_tree(sums(i, j, g), sums(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i)]
        self.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[: self.n_pairs]]
        self.pair_tables = [np.zeros(shape(i, j)) for i, j in self.pairs]
        for _ in range(self.pair_rounds):
            for (i, j), table in zip(self.pairs, self.pair_tables):
                g, h = slopes()
                step = self.rate * self._pair_tree(sums(i, j, g), sums(i, j, h))[1]
                table += step
                raw += step[b[:, i], b[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        raw = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            raw += table[b[:, i]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            raw += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))


def training_rows(measured: DataFrame, labels: DataFrame, most_rows: int, label_col: str = "quality") -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most_rows`` labelled documents, those whose ids have the smallest hashes; a document counts as often as it meets a label."""
    usable = labels.filter(F.col(label_col).isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1)).select(
        F.col("doc_id").cast("long").alias("__id"), F.col(label_col).cast("int").alias("y")
    )
    met = measured.join(usable, F.col("doc_id") == F.col("__id")).select("doc_id", "x", "y")
    n = met.count()
    share, place = 1 << 20, F.xxhash64("doc_id")
    if n > most_rows:
        # about so many by hash, where each lies; ids with many rows can make it more, so the order decides
        met = met.filter(F.pmod(place, F.lit(share)) < share * 2 * most_rows // n)
    rows = met.orderBy(F.pmod(place, F.lit(share)), "doc_id", "y", "x").limit(most_rows).collect()
    rows.sort(key=lambda r: (r.doc_id, r.y, r.x))
    return np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], dtype=float)


def score_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    measured = cut(document_features(docs, id_col, text_col))
    model = AdditiveModel().fit(*training_rows(measured, labels, most_rows))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), dtype=float).reshape(batch.num_rows, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = measured.mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")
