"""Vector aggregates: centroids, class geometry, spectra, population gaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import vectors as v


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, mean): element-wise mean; components are averaged by hash aggregation."""
    long = df.select(*keys, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(*keys, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return means.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def class_geometry(df: DataFrame, group: str, label: str, vector: str) -> DataFrame:
    """(group, intra, inter_mean, inter_std, fisher).

    ``intra`` averages over classes the mean squared difference to the centroid
    over rows and components.  The centroids - one for each class - are paired
    with one another; rows only meet their own.
    """
    centroids = mean_vectors(df, [group, label], vector)
    spread = df.join(centroids.select(group, label, "mean"), [group, label])
    size = F.aggregate(F.zip_with(vector, "mean", lambda x, m: (x - m) * (x - m)), F.lit(0.0), lambda a, x: a + x) / F.size(vector)
    intra = spread.groupBy(group, label).agg(F.avg(size).alias("w")).groupBy(group).agg(F.avg("w").alias("intra"))
    other = centroids.select(group, F.col(label).alias("__l"), F.col("mean").alias("__m"))
    pairs = centroids.join(other, group).filter(F.col(label) < F.col("__l"))
    inter = pairs.groupBy(group).agg(F.avg(v.distance(F.col("mean"), F.col("__m"))).alias("inter_mean"), F.stddev_pop(v.distance(F.col("mean"), F.col("__m"))).alias("inter_std"))
    return intra.join(inter, group, "left").select(
        group, "intra", F.coalesce("inter_mean", F.lit(0.0)).alias("inter_mean"), F.coalesce("inter_std", F.lit(0.0)).alias("inter_std"),
        (F.coalesce("inter_mean", F.lit(0.0)) / (F.col("intra") + 1e-12)).alias("fisher"),
    )


def confidence_features(df: DataFrame, keys: list[str], probs: str, logits: str, label: str) -> DataFrame:
    """Mean and population deviation of true-class probability, margin, entropy and logit norm."""
    cells = {
        "true_prob": v.at(F.col(probs), F.col(label)),
        "margin": v.margin(F.col(probs)),
        "entropy": v.entropy(F.col(probs)),
        "logit_norm": v.norm(F.col(logits)),
    }
    narrow = df.select(*keys, *[c.alias(n) for n, c in cells.items()])
    return narrow.groupBy(*keys).agg(*[f(n).alias(f"{n}_{s}") for n in cells for s, f in (("mean", F.avg), ("std", F.stddev_pop))])


def gaps(df: DataFrame, keys: list[str], side: str, values: list[str], mix="mix", pop="pop") -> DataFrame:
    """Columns mix_*, pop_* and gap_* from a row for each side."""
    one = lambda c, s: F.max(F.when(F.col(side) == s, F.col(c)))
    aggs = [one(c, s).alias(f"{p}_{c}") for c in values for p, s in (("mix", mix), ("pop", pop))]
    wide = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return wide.select("*", *[(F.col(f"mix_{c}") - F.col(f"pop_{c}")).alias(f"gap_{c}") for c in values])


def feature_distance(df: DataFrame, keys: list[str], side: str, vector: str, mix="mix", pop="pop") -> DataFrame:
    """Distance and cosine of the two sides' mean vectors."""
    means = mean_vectors(df, [*keys, side], vector)
    one = lambda s: F.max(F.when(F.col(side) == s, F.col("mean")))
    wide = means.groupBy(*keys).agg(one(mix).alias("a"), one(pop).alias("b"))
    return wide.select(*keys, v.distance(F.col("a"), F.col("b")).alias("feat_l2"), v.cosine(F.col("a"), F.col("b")).alias("feat_cos"))


def spectrum(values: np.ndarray) -> dict[str, float]:
    lam = np.sort(np.maximum(values, 1e-12))[::-1]
    share = lam / lam.sum()
    return {
        "spec_entropy": float(-(share * np.log(share + 1e-12)).sum()),
        "participation": float(lam.sum() ** 2 / (lam**2).sum()),
        "stable_rank": float(lam.sum() / lam[0]),
        **{f"top{k}": float(share[:k].sum()) for k in (1, 5, 10)},
    }


BLOCK_ROWS = 64  # rows of a matrix that are one row of a table
FAN = 32  # partial results that are joined in one go
BATCH = 4096


def _joined(parts):
    """(n, mean, products about the mean) of several such, one after another."""
    n, mean, block = 0, 0.0, 0.0
    for first, m, other, products in parts:
        if not m:
            continue
        gap = other - mean
        block = block + products + np.outer(gap[first : first + len(products)], gap) * (n * m / (n + m))
        mean, n = mean + gap * (m / (n + m)), n + m
    return n, mean, block


def covariance_blocks(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, first, n, mean, block): products about the mean, ``BLOCK_ROWS`` rows of the matrix in each row, from ``first`` on.

    A task adds up its own vectors of each group by matrix products and sends
    one row a block; these are joined ``FAN`` at a time, first by task, then by
    group, so that no task holds more than some of one block.  Null vectors are
    left out; those of a group should have one length.
    """
    kind = df.schema[group].dataType.simpleString()
    schema = f"`{group}` {kind}, first int, n bigint, mean array<double>, block array<double>"
    names = [group, "first", "n", "mean", "block"]

    def rows_of(mark, n, mean, products):
        for first in range(0, len(mean), BLOCK_ROWS):
            yield mark, first, n, mean.tolist(), products[first : first + BLOCK_ROWS].ravel().tolist()

    def sums(batches):
        held = {}
        for batch in batches:
            coded = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for at in np.split(order, cuts):
                mark = coded.dictionary[int(codes[at[0]])].as_py()
                lists = batch.column(1).take(pa.array(at))
                for start in range(0, len(lists), BATCH):
                    some = lists[start : start + BATCH]
                    x = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1).astype(float)
                    mean = x.mean(axis=0)
                    y = x - mean
                    held[mark] = _joined([(0, *held[mark]), (0, len(x), mean, y.T @ y)]) if mark in held else (len(x), mean, y.T @ y)
        for mark, (n, mean, products) in held.items():
            for row in rows_of(mark, n, mean, products):
                yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=to_arrow_schema(wanted))

    def join(key, pdf: pd.DataFrame) -> pd.DataFrame:
        width = len(pdf["mean"].iloc[0])
        n, mean, block = _joined((key[1], int(m), np.asarray(a), np.asarray(b).reshape(-1, width)) for m, a, b in zip(pdf["n"], pdf["mean"], pdf["block"]))
        return pd.DataFrame({group: [key[0]], "first": [key[1]], "n": [n], "mean": [mean.tolist()], "block": [np.ravel(block).tolist()]})

    narrow = df.select(group, F.col(vector).cast("array<double>").alias("__x")).filter("__x is not null and size(__x) > 0")
    wanted = df.sparkSession.createDataFrame([], schema).schema
    parts = narrow.mapInArrow(sums, wanted).withColumn("__task", F.floor(F.spark_partition_id() / FAN))
    return parts.groupBy(group, "first", "__task").applyInPandas(join, wanted).groupBy(group, "first").applyInPandas(join, wanted)


def spectral_features(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, six features) of the eigenvalues of the sample covariance; what reaches one task is one matrix of the width of the vectors."""
    names = ["spec_entropy", "participation", "stable_rank", "top1", "top5", "top10"]

    def solve(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        width, n = len(pdf["mean"].iloc[0]), int(pdf["n"].iloc[0])
        m = np.concatenate([np.asarray(b).reshape(-1, width) for b in pdf["block"]]) / max(1, n - 1)
        return pd.DataFrame([{group: key[0], **spectrum(np.linalg.eigvalsh((m + m.T) / 2))}])

    kind = df.schema[group].dataType.simpleString()
    return covariance_blocks(df, group, vector).groupBy(group).applyInPandas(solve, f"`{group}` {kind}, " + ", ".join(f"{n} double" for n in names))


def symmetric_kl(p: DataFrame, q: DataFrame, bin_col: str, eps: float = 1e-12) -> DataFrame:
    """One row: the symmetric divergence of two histograms (bin, n), renormalised, over all bins of either."""
    left, right = p.select(bin_col, F.col("n").alias("__a")), q.select(bin_col, F.col("n").alias("__b"))
    joined = left.join(right, bin_col, "full").fillna(0, ["__a", "__b"])
    sums = joined.agg(F.sum("__a").alias("__sa"), F.sum("__b").alias("__sb"))
    share = joined.crossJoin(F.broadcast(sums)).select((F.col("__a") / F.col("__sa") + eps).alias("p"), (F.col("__b") / F.col("__sb") + eps).alias("q"))
    return share.agg((0.5 * F.sum(F.col("p") * F.log(F.col("p") / F.col("q")) + F.col("q") * F.log(F.col("q") / F.col("p")))).alias("kl"))


def label_histogram(df: DataFrame, label: str, classes: int) -> DataFrame:
    """Share of each class 0 to classes - 1, absent ones included."""
    counts = df.groupBy(F.col(label).cast("long").alias("label")).agg(F.count("*").alias("n"))
    full = df.sparkSession.range(classes).withColumnRenamed("id", "label").join(counts, "label", "left").fillna(0, ["n"])
    total = full.groupBy().agg(F.sum("n").alias("t"))
    return full.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("t")).alias("share"))
