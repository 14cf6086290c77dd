"""Learners over feature tables, and sampling."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import shared_folder
from .boosting import BoostedTrees, binned
from .boosting_sums import feature_cuts, learn_folds
from .evaluate import hash_order, hash_positions, stratified_folds


def _matrix(frame: pd.DataFrame, features: list[str]) -> np.ndarray:
    return np.nan_to_num(frame[features].to_numpy(dtype=float), posinf=1e300, neginf=-1e300)


def _finite(name: str) -> F.Column:
    """As ``_matrix`` reads a column."""
    x = F.col(name).cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.least(x, F.lit(1e300)), F.lit(-1e300)))


def held_once(df: DataFrame) -> DataFrame:
    """``df`` worked out once: written to the shared folder, as learners read it many times and features cost more than learning."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def boosted_oof(df: DataFrame, features: list[str], label: str, key: str, test: DataFrame | None = None, k: int = 5, seed: int = 42, most_rows: int = 1_500_000, draws: str = "order", **how):
    """Out-of-fold scores, scores of ``test`` averaged over folds, and mean feature importances (gain).

    Each fold's model is learned from all rows of the other folds, and stops
    early on the fold it leaves out; rows without a label are only scored.  Up
    to ``most_rows`` rows a fold is learned in a task of its own, which holds two
    bytes a feature and row (45 MB of the fifteen features at that limit); beyond
    that all folds grow from sums over the table (``boosting_sums``).  With ``draws``
    "key" the models are the same either way: which rows a round's draw takes
    follows from a hash of their key.  "order" draws places in the order of the
    keys where the rows fit a task.  Every row is scored, where it lies, by the
    model of its fold.  ``how``: parameters of ``BoostedTrees``.
    """
    folds = stratified_folds(df, label, key, k, seed).select(key, F.col(label).cast("double").alias("__y"), F.col(label).alias("__label"), "fold", *[F.col(f).cast("double") for f in features])
    folds = held_once(folds)
    number = F.xxhash64(F.col(key).cast("string")).alias("id")
    names = [f"x{i}" for i in range(len(features))]
    known = folds.filter("__y is not null").select(F.col(key).alias("key"), F.col("__y").alias("y"), "fold", number, *[_finite(f).alias(x) for f, x in zip(features, names)])
    how = {"seed": seed, **how}
    small = known.count() <= most_rows
    by_key = draws == "key" or not small
    cuts = feature_cuts(known, names, how.get("bins", BoostedTrees().bins)) if by_key else None

    def pack(frames):
        for frame in frames:
            yield frame[["y", "fold", "id"]].assign(bins=[b.tobytes() for b in binned(frame[names].to_numpy(dtype=float), cuts)])

    def fit(group, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame if by_key else frame.sort_values("key", kind="stable")
        out, y = (frame["fold"] == group[0]).to_numpy(), frame["y"].to_numpy()
        if by_key:
            b, ids = np.frombuffer(b"".join(frame["bins"]), dtype=np.uint16).reshape(len(y), -1), frame["id"].to_numpy()
            model = BoostedTrees(**how).fit_bins(b[~out], y[~out], b[out], y[out], ids[~out], cuts)
        else:
            x = frame[names].to_numpy(dtype=float)
            model = BoostedTrees(**how).fit(x[~out], y[~out], x[out], y[out])
        return pd.DataFrame({"model": [group[0]], "held": [model.dump()]})

    if small:
        read = known.select("y", "fold", "id", *names).mapInPandas(pack, "y double, fold int, id long, bins binary") if by_key else known
        dealt = read.withColumn("model", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        # k rows, of a size that rounds and leaves bound
        models = {r.model: bytes(r.held) for r in dealt.groupBy("model").applyInPandas(fit, "model int, held binary").collect()}
    else:
        models = {m: model.dump() for m, model in learn_folds(known.drop("key"), names, cuts, k, how).items()}
    shared = df.sparkSession.sparkContext.broadcast(models)
    kind = {f.name: f.dataType.simpleString() for f in df.schema}

    def score(frames):
        held = {m: pickle.loads(x) for m, x in shared.value.items()}
        for frame in frames:
            found = np.zeros(len(frame))
            for m in frame["fold"].unique():
                rows = (frame["fold"] == m).to_numpy()
                found[rows] = held[m].score(_matrix(frame[rows], features)) if m in held else 0.5
            yield pd.DataFrame({key: frame[key], label: frame["__label"], "fold": frame["fold"], "score": found})

    def score_all(frames):
        held = [pickle.loads(x) for x in shared.value.values()]
        for frame in frames:
            x = _matrix(frame, features)
            yield pd.DataFrame({key: frame[key], "score": np.mean([m.score(x) for m in held], axis=0) if held else np.full(len(x), 0.5)})

    scores = folds.mapInPandas(score, f"`{key}` {kind[key]}, `{label}` {kind[label]}, fold int, score double")
    averaged = test.select(key, *features).mapInPandas(score_all, f"`{key}` {kind[key]}, score double") if test is not None else None
    gains = np.mean([pickle.loads(x).gains for x in models.values()], axis=0) if models else np.zeros(len(features))
    importances = df.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, gains)], "feature string, importance double")
    return scores, averaged, importances


def top_features(importances: DataFrame, k: int = 15) -> DataFrame:
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def ridge_and_forest(train: DataFrame, test: DataFrame, features: list[str], target: str, key: str, alpha: float = 1.0, trees: int = 400, depth: int = 7, least: int = 2, prior: float | None = None, seed: int = 42) -> DataFrame:
    """(key, ridge, forest, proportion): mean of a standardised ridge regression and a forest, drawn to a prior, clipped.

    ``train`` is read about five times, ``test`` once: costly features go through ``held_once`` first.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="__f")
    n = max(1, train.count())
    # the linear objective here is a mean of squares over two, so the penalty is alpha over n
    ridge = Pipeline(stages=[assembler, StandardScaler(inputCol="__f", outputCol="__s", withMean=True), LinearRegression(featuresCol="__s", labelCol=target, regParam=alpha / n, elasticNetParam=0.0, predictionCol="ridge")]).fit(train)
    forest = Pipeline(stages=[assembler, RandomForestRegressor(featuresCol="__f", labelCol=target, numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed, predictionCol="forest")]).fit(train)
    both = forest.transform(ridge.transform(test).drop("__f", "__s")).withColumn("p", 0.5 * F.col("ridge") + 0.5 * F.col("forest"))
    blended = F.col("p") if prior is None else 0.68 * F.col("p") + 0.32 * F.lit(prior)
    return both.select(key, "ridge", "forest", F.least(F.greatest(blended, F.lit(0.0)), F.lit(1.0)).alias("proportion"))


def mixture_sample(df: DataFrame, side: str, key: str, n: int, share: float, draw: int = 0) -> DataFrame:
    """``n`` rows without replacement, ``share`` of them from the mixed side, by hash order of draw and key."""
    placed = hash_positions(df, [side], hash_order(str(draw), key), key, "__n")
    wanted = F.when(F.col(side) == "mix", round(n * share)).otherwise(n - round(n * share))
    return placed.filter(F.col("__n") < wanted).drop("__n").withColumn("draw", F.lit(draw))


def resample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` draws with replacement: each picks a place by hash among rows in the order of a hash of their key."""
    numbered = hash_positions(df, [], F.md5(F.col(key).cast("string")), key, "__i")
    n = df.count()
    at = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("long") % F.lit(max(1, n))
    draws = df.sparkSession.range(k).select(at.alias("__i"), F.col("id").alias("draw"))
    return draws.join(numbered, "__i").drop("__i")


def repeat_rows(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
