"""Gradient boosted trees learned from all rows of a table: slopes are summed by node, feature and bin as an aggregation.

The table of bins and raw scores is written to the shared folder, and again
after every ``block`` rounds, so a lost executor costs at most the trees since.
A pass over it adds up the slopes of all leaves that any fold's tree may cut
next; only those sums (folds x leaves x features x bins at most, whatever the
rows) reach the driver, where the trees grow.  The trees are those that
``BoostedTrees.fit`` grows of the same rows and ids, bit for bit: slopes are whole
numbers, and draws are hashes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import shared_folder
from .boosting import BoostedTrees, Growth, binned, drawn, outputs, places, slopes, sums_by_bin
from .evaluate import roc_points

TASK_ROWS = 50_000
PACKED = "y double, fold int, id long, bins binary, raw binary"


def feature_cuts(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Cuts between about equal parts of each feature's values, from one mergeable sketch a feature."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.struct(F.percentile_approx(f, at, 4 * bins).alias("at"), F.max(f).alias("top")).alias(f"f{i}") for i, f in enumerate(features)]).first()
    return [np.array(sorted({x for x in c["at"] or [] if x < c["top"]}), dtype=float) for c in found]


def _unpacked(frame: pd.DataFrame, width: int, k: int):
    """Bins, raw scores (writable), labels, folds and ids of a batch."""
    b = np.frombuffer(b"".join(frame["bins"]), dtype=np.uint16).reshape(-1, width)
    raw = np.frombuffer(b"".join(frame["raw"]), dtype=np.float64).reshape(-1, k).copy()
    return b, raw, frame["y"].to_numpy(), frame["fold"].to_numpy(), frame["id"].to_numpy()


def _packed(raw: np.ndarray) -> list[bytes]:
    return [r.tobytes() for r in np.ascontiguousarray(raw)]


def _summed(table: DataFrame, width: int, k: int, asked: dict, draw: int, share: float, bins: int) -> dict:
    """{(fold, place in what is asked): sums by bin}.

    ``asked``: for each fold its trees since the table was written, the features, and what to
    sum: a tree as far as grown with the (node, feature, bin) whose lower sides are wanted, or
    None for all rows.
    """

    def run(frames):
        held = {}
        for frame in frames:
            b, raw, y, fold, ids = _unpacked(frame, width, k)
            taken = drawn(ids, draw, share)
            for m, (trees, features, part, cuts) in asked.items():
                own = np.flatnonzero(taken & (fold != m))
                bo, score = b[own], raw[own, m]
                for tree in trees:
                    score = score + outputs(tree, bo)
                slope = slopes(score, y[own])
                at = None if part is None else places(part, bo)
                for i, (node, f, cut) in enumerate(cuts):
                    low = slice(None) if at is None else (at == node) & (bo[:, f] <= cut)
                    found = sums_by_bin(bo[low], slope[low], features, bins)
                    held[m, i] = held[m, i] + found if (m, i) in held else found
        for (m, i), sums in held.items():
            f, at = np.nonzero(sums[:, :, 2])
            yield pd.DataFrame({"m": m, "i": i, "f": f, "at": at, "g": sums[f, at, 0], "h": sums[f, at, 1], "n": sums[f, at, 2]})

    parts = table.mapInPandas(run, "m int, i int, f int, at int, g long, h long, n long")
    total = parts.groupBy("m", "i", "f", "at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow().to_pandas()
    out = {(m, i): np.zeros((width, bins, 3), dtype=np.int64) for m, a in asked.items() for i in range(len(a[3]))}
    for (m, i), rows in total.groupby(["m", "i"]):
        out[m, i][rows["f"], rows["at"]] = rows[["g", "h", "n"]].to_numpy()
    return out


def _held_out(table: DataFrame, width: int, k: int, made: dict[int, list], block: int) -> dict:
    """{(fold, round of the block): area under the curve over the rows that the fold leaves out}; one class has none."""

    def run(frames):
        for frame in frames:
            b, raw, y, fold, _ = _unpacked(frame, width, k)
            for m, trees in made.items():
                own = np.flatnonzero(fold == m)
                bo, score = b[own], raw[own, m]
                for i, tree in enumerate(trees):
                    score = score + outputs(tree, bo)
                    yield pd.DataFrame({"part": m * block + i, "score": score, "y": y[own]})

    points = roc_points(table.mapInPandas(run, "part int, score double, y double"), "y", "score", "part")
    # twice the number of pairs in the right order, ties counted once
    pairs = F.sum(F.col("f").cast("double") * (2 * (F.col("tp") - F.col("t")) + F.col("t")))
    areas = points.groupBy("part").agg(pairs.alias("u"), F.max("fp").alias("nf"), F.max("tp").alias("nt")).collect()
    return {divmod(r.part, block): r.u / 2 / (r.nt * r.nf) for r in areas if r.nt and r.nf}


def learn_folds(rows: DataFrame, features: list[str], cuts: list[np.ndarray], k: int, how: dict, block: int = 20) -> dict[int, BoostedTrees]:
    """A model for each fold, learned from the rows of all others, stopped early by its own.

    ``rows``: y (0 or 1), fold, id (a number that decides draws), and the features
    as finite doubles.  Each round takes about as many passes as the tree is deep.
    """
    spark = rows.sparkSession
    models = {m: BoostedTrees(**how) for m in range(k)}
    counts = {r.fold: (r.ones, r.n) for r in rows.groupBy("fold").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).collect()}
    ones, n = (sum(c[j] for c in counts.values()) for j in (0, 1))
    live = [m for m, model in models.items() if model.begin(ones - counts.get(m, (0, 0))[0], n - counts.get(m, (0, 0))[1], cuts)]
    width, folder, starts = len(features), f"{shared_folder(spark)}/boost-{uuid.uuid4().hex}", [models[m].start for m in range(k)]

    def pack(frames):
        for frame in frames:
            b = binned(frame[features].to_numpy(dtype=float), cuts)
            yield pd.DataFrame({"y": frame["y"], "fold": frame["fold"], "id": frame["id"], "bins": _packed(b), "raw": _packed(np.tile(np.array(starts), (len(b), 1)))})

    def write(table: DataFrame, name: int) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def remove(name: int | str = "") -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}".rstrip("/"))
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    step = 0
    # a shuffle of narrow rows, once: every pass has tasks of one size
    even = rows.select("y", "fold", "id", *features).repartition(1 + n // TASK_ROWS)
    table = write(even.mapInPandas(pack, PACKED), 0) if live else None
    try:
        while live:
            first, made = step, {m: [] for m in live}
            while step < min(first + block, models[live[0]].rounds):
                _round(table, width, k, {m: models[m] for m in live}, made, step)
                step += 1
            areas = _held_out(table, width, k, made, block)
            stopped = {m for m in live if any(models[m].judge(first + i, areas.get((m, i), 0.5)) for i in range(step - first))}
            live = [m for m in live if m not in stopped] if step < models[live[0]].rounds else []
            if live:
                table = write(table.mapInPandas(_adder(width, k, {m: made[m] for m in live}), PACKED), step)
                remove(first)
    finally:
        remove()
    return {m: model.end() for m, model in models.items()}


def _adder(width: int, k: int, made: dict[int, list]):
    def run(frames):
        for frame in frames:
            b, raw, *_ = _unpacked(frame, width, k)
            for m, trees in made.items():
                for tree in trees:
                    raw[:, m] += outputs(tree, b)
            yield frame.assign(raw=_packed(raw))

    return run


def _round(table: DataFrame, width: int, k: int, models: dict[int, BoostedTrees], made: dict[int, list], step: int) -> None:
    """Grow a tree for each fold; all folds share the passes."""
    how = next(iter(models.values()))
    ask = lambda asked: _summed(table, width, k, asked, step // how.draw_every, how.row_share, how.bins)
    features = {m: model.features() for m, model in models.items()}
    roots = ask({m: (made[m], features[m], None, [(0, 0, 0)]) for m in models})
    growing = {m: Growth(models[m], features[m], roots[m, 0]) for m in models}
    while wanted := {m: nodes for m, growth in growing.items() if (nodes := growth.wanted())}:
        asked = {}
        for m, nodes in wanted.items():
            part, numbers, _ = growing[m].flat()
            asked[m] = (made[m], features[m], part, [(numbers.index(node), *growing[m].cuts[node][1:]) for node in nodes])
        for (m, i), low in ask(asked).items():
            growing[m].give(wanted[m][i], low)
    for m, growth in growing.items():
        tree, _, gains = growth.flat()
        models[m].keep(tree, gains)
        made[m].append(tree)
