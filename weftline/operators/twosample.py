"""Two populations of one model: how much of the mixed set looks like members.

Tables are long: a row for each (model, side, sample), side 'mix' or 'pop'; all
models are estimated in one job, with the model as the grouping key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from .ordered import few, quantiles, running_sums

MIX, POP = "mix", "pop"


def on(side: str, value: Column, column: str = "side") -> Column:
    return F.when(F.col(column) == side, value)


def median_and_iqr(df: DataFrame, keys: list[str], value: str, median: str = "med", spread: str = "iqr") -> DataFrame:
    found = quantiles(df, keys, value, {"__q25": 0.25, "__q50": 0.5, "__q75": 0.75})
    return found.select(*keys, F.col("__q50").alias(median), (F.col("__q75") - F.col("__q25")).alias(spread))


def class_z(df: DataFrame, value: str, label: str, least: int = 2, low_is_member: bool = True, model: str = "model_id") -> DataFrame:
    """``df`` with ``z``: the value standardised by its class in the population side.

    Classes with fewer than ``least`` rows there, and those absent, use the
    whole side's moments.
    """
    pop = df.filter(F.col("side") == POP)
    by_class = pop.groupBy(model, label).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"), F.count("*").alias("__n"))
    whole = pop.groupBy(model).agg(F.avg(value).alias("__gm"), F.stddev_pop(value).alias("__gs"))
    own = F.coalesce(F.col("__n"), F.lit(0)) >= least
    mean, std = F.when(own, F.col("__m")).otherwise(F.col("__gm")), F.when(own, F.col("__s")).otherwise(F.col("__gs")) + 1e-8
    z = (F.col(value) - mean) / std
    joined = df.join(by_class, [model, label], "left").join(whole, model)
    return joined.withColumn("z", z if low_is_member else -z).drop("__m", "__s", "__n", "__gm", "__gs")


def thresholds(low: float, high: float, count: int) -> Column:
    """An array of evenly spaced values, both ends included."""
    step = (high - low) / (count - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.lit(low) + i * step)


def share_below(df: DataFrame, value: str, grid: Column, model: str = "model_id") -> DataFrame:
    """(model, t, f_mix, f_pop): share of each side at or below each threshold.

    A row finds its first threshold and is counted there; running sums over the
    grid do the rest, so rows are never multiplied by the grid.
    """
    slots = df.select(model, "side", F.size(F.filter(grid, lambda t: t < F.col(value))).alias("k"))
    counts = slots.groupBy(model, "k").agg(F.count(on(MIX, F.lit(1))).alias("m"), F.count(on(POP, F.lit(1))).alias("p"))
    marks = df.select(model).distinct().select(model, F.posexplode(grid).alias("k", "t"))
    by = Window.partitionBy(model)
    full = marks.join(counts, [model, "k"], "full").fillna(0, ["m", "p"])
    run = by.orderBy("k")
    return full.select(
        model, "t", (F.sum("m").over(run) / F.sum("m").over(by)).alias("f_mix"), (F.sum("p").over(run) / F.sum("p").over(by)).alias("f_pop")
    ).filter(F.col("t").isNotNull())


def proportion_class_cdf(df: DataFrame, value: str, label: str, least: int = 2, low_is_member: bool = True, model: str = "model_id") -> DataFrame:
    """Median, over thresholds in the left tail, of the excess of the mixed side's share."""
    z = class_z(df, value, label, least, low_is_member, model)
    f = share_below(z, "z", thresholds(-2.5, -0.2, 24), model)
    est = (F.col("f_mix") - F.col("f_pop")) / (1.0 - F.col("f_pop") + 1e-9)
    usable = (F.col("f_pop") > 1e-3) & (F.col("f_pop") < 0.95) & (est >= 0.0) & (est <= 1.5)
    return f.groupBy(model).agg(v.clip(F.coalesce(F.median(F.when(usable, est)), F.lit(0.0))).alias("proportion"))


def reference_counts(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mixed rows with ``r``, the number of population rows at or below, and ``m``, that of all of them.

    Rows are first counted by distinct value; a running sum over those replaces
    the inequality join.
    """
    counts = df.groupBy(*keys, value).agg(F.count(on(POP, F.lit(1))).alias("c"))
    ranked = running_sums(counts, keys, value, ["c"]).select(*keys, value, F.col("run_c").alias("r"), F.col("all_c").alias("m"))
    return df.filter(F.col("side") == MIX).join(ranked, [*keys, value])


def reference_quantile(df: DataFrame, value: str, keys: list[str], low_is_member: bool = True) -> DataFrame:
    """Mixed rows with ``q`` = (r + 0.5) / (M + 1), kept off 0 and 1."""
    q = v.clip((F.col("r") + 0.5) / (F.col("m") + 1.0), 1e-6, 1 - 1e-6)
    return reference_counts(df, value, keys).withColumn("q", q if low_is_member else 1.0 - q)


def rank_fraction(df: DataFrame, value: str, keys: list[str], name: str, higher_is_member: bool = True) -> DataFrame:
    """Every row, of both sides, with ``name``: the share of the population at or below it, flipped if lower is better."""
    counts = df.groupBy(*keys, value).agg(F.count(on(POP, F.lit(1))).alias("c"))
    share = F.col("run_c") / F.col("all_c")
    ranked = running_sums(counts, keys, value, ["c"]).select(*keys, value, (share if higher_is_member else 1.0 - share).alias(name))
    return df.join(ranked, [*keys, value])


def ks_grid() -> tuple[Column, Column]:
    """The exponents and proportions that are tried; fixed values."""
    exponents = F.concat(thresholds(0.3, 3.0, 28), thresholds(3.5, 20.0, 34), F.array(F.lit(30.0), F.lit(50.0), F.lit(100.0)))
    return exponents, thresholds(0.0, 1.0, 101)


def proportion_ks_grid(quantiles: DataFrame, q: str = "q", model: str = "model_id") -> DataFrame:
    """(model, ks_error, ks_exponent, proportion): the grid point whose curve is nearest the quantiles' distribution.

    The grid doesn't grow with the data: samples meet 99 thresholds, and only
    those sums meet the grid.
    """
    marks = thresholds(0.01, 0.99, 99)
    slots = quantiles.select(model, F.size(F.filter(marks, lambda t: t < F.col(q))).alias("k")).groupBy(model, "k").agg(F.count("*").alias("c"))
    by = Window.partitionBy(model)
    full = quantiles.select(model).distinct().select(model, F.posexplode(marks).alias("k", "t")).join(slots, [model, "k"], "full").fillna(0, ["c"])
    ecdf = full.select(model, "t", (F.sum("c").over(by.orderBy("k")) / F.sum("c").over(by)).alias("e")).filter("t is not null")
    exponents, proportions = ks_grid()
    curves = ecdf.withColumn("b", F.explode(exponents)).withColumn("d", 1.0 - F.pow(1.0 - F.col("t"), F.col("b") + 1.0) - F.col("t"))
    tried = curves.select(model, "b", "t", "e", "d", F.explode(proportions).alias("p"))
    errors = tried.groupBy(model, "b", "p").agg(F.max(F.abs(F.col("e") - (F.col("t") + F.col("p") * F.col("d")))).alias("err"))
    best = errors.groupBy(model).agg(F.min(F.struct(F.round("err", 12).alias("err"), "b", "p")).alias("x"))
    return best.select(model, F.col("x.err").alias("ks_error"), F.col("x.b").alias("ks_exponent"), F.col("x.p").alias("proportion"))


def proportion_lira(df: DataFrame, value: str, label: str, least: int = 5, model: str = "model_id") -> DataFrame:
    """Mean soft membership of the mixed side by class-conditional z."""
    z = class_z(df, value, label, least, True, model).filter(F.col("side") == MIX)
    return z.groupBy(model).agg(F.avg(v.sigmoid(-(F.col("z") + 1.0) / 0.5)).alias("proportion"))


def proportion_cross_null(df: DataFrame, value: str, arch: str, null_of: DataFrame, model: str = "model_id") -> DataFrame:
    """Each model's mixed side against the null model of its family; null models themselves get null.

    ``null_of``: (arch, null_id).
    """
    mix = df.filter(F.col("side") == MIX)
    named = null_of.select(F.col(arch).alias("__arch"), "null_id")
    null = quantiles(mix.join(named, F.col(model) == F.col("null_id")), ["__arch", "null_id"], value, {"__q05": 0.05, "__q25": 0.25, "__med": 0.5, "__q75": 0.75})
    null = null.withColumn("__iqr", F.col("__q75") - F.col("__q25") + 1e-8).drop("__q25", "__q75")
    joined = mix.join(null, F.col(arch) == F.col("__arch"))
    low = F.avg((F.col(value) < F.col("__q05")).cast("double"))
    shift = v.saturate(F.greatest(-(F.col(value) - F.col("__med")) / F.col("__iqr"), F.lit(0.0)))
    out = joined.groupBy(model, "null_id").agg((0.5 * low + 0.5 * F.avg(shift)).alias("e"))
    return out.select(model, F.when(F.col(model) != F.col("null_id"), F.col("e")).alias("proportion"))


def proportion_augmented(df: DataFrame, value: str, sample: str, model: str = "model_id") -> DataFrame:
    """Stability under augmentation: samples whose loss is low and steady count as members."""
    each = df.groupBy(model, "side", sample).agg(F.avg(value).alias("a"), F.stddev_pop(value).alias("s"))
    side = each.filter(F.col("side") == POP)
    pop = median_and_iqr(side, [model], "a", "ma", "ia").join(median_and_iqr(side, [model], "s", "ms", "is_"), model)
    pop = pop.withColumn("ia", F.col("ia") + 1e-8).withColumn("is_", F.col("is_") + 1e-8)
    score = -((F.col("a") - F.col("ma")) / F.col("ia") + (F.col("s") - F.col("ms")) / F.col("is_")) / 2.0
    return each.filter(F.col("side") == MIX).join(pop, model).groupBy(model).agg(F.avg(v.sigmoid((score - 0.5) / 0.5)).alias("proportion"))


# fixed values: weights of the gap score and of the rank ensemble
GAP_WEIGHTS = {"true_prob": 3.5, "confidence": 2.5, "margin": 2.0, "entropy": -1.5, "loss": -2.5, "high_conf": 3.0}
KL_WEIGHT = 0.5
RANK_WEIGHTS = {"true_logit": (0.30, True), "margin": (0.25, True), "confidence": (0.20, True), "energy": (0.15, True), "loss": (0.10, False)}


def gap_score(df: DataFrame, predicted: str, classes: int, model: str = "model_id") -> DataFrame:
    """Weighted gaps of the sides' means, and of their histograms of predicted classes.

    ``df`` has true_prob, confidence, margin, entropy and loss; each side's true
    probability is by its own labels.
    """
    cells = {**{c: F.col(c) for c in GAP_WEIGHTS if c != "high_conf"}, "high_conf": (F.col("confidence") > 0.90).cast("double")}
    gap = sum((w * (F.avg(on(MIX, cells[c])) - F.avg(on(POP, cells[c]))) for c, w in GAP_WEIGHTS.items()), F.lit(0.0))
    means = df.groupBy(model).agg(gap.alias("gap"))
    hist = df.groupBy(model, predicted).agg(F.count(on(MIX, F.lit(1))).alias("m"), F.count(on(POP, F.lit(1))).alias("p"))
    grid = df.select(model).distinct().withColumn(predicted, F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    full = grid.join(hist, [model, predicted], "left").fillna(0, ["m", "p"])
    by = Window.partitionBy(model)
    p, q = F.col("m") / F.sum("m").over(by) + 1e-12, F.col("p") / F.sum("p").over(by) + 1e-12
    shares = full.select(model, p.alias("p"), q.alias("q"))
    kl = shares.groupBy(model).agg((0.5 * F.sum(F.col("p") * F.log(F.col("p") / F.col("q")) + F.col("q") * F.log(F.col("q") / F.col("p")))).alias("kl"))
    return means.join(kl, model).select(model, (F.col("gap") + KL_WEIGHT * F.col("kl")).alias("score"))


def robust_z(df: DataFrame, value: str, model: str = "model_id") -> DataFrame:
    """``df`` with ``z``: the distance to the population's median in scaled median absolute deviations."""
    pop = df.filter(F.col("side") == POP)
    med = quantiles(pop, [model], value, {"__med": 0.5})
    med = few(med) or med
    mad = quantiles(pop.join(med, model).withColumn("__off", F.abs(F.col(value) - F.col("__med"))), [model], "__off", {"__mad": 0.5})
    mad = few(mad) or mad
    return df.join(med.join(mad, model), model).withColumn("z", (F.col(value) - F.col("__med")) / (1.4826 * F.col("__mad") + 1e-8)).drop("__med", "__mad")


def rank_ensemble(df: DataFrame, key: str, model: str = "model_id") -> DataFrame:
    """(key, model, side, score): the weighted shares of the population that each metric is at or above.

    All metrics are ranked together in long form: one aggregation, one join.
    """
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in RANK_WEIGHTS])
    long = df.select(key, model, "side", F.explode(cells).alias("c")).select(key, model, "side", "c.metric", "c.x")
    ranked = rank_fraction(long, "x", [model, "metric"], "r")
    parts = [F.when(F.col("metric") == m, w * (F.col("r") if higher else 1.0 - F.col("r"))) for m, (w, higher) in RANK_WEIGHTS.items()]
    return ranked.groupBy(key, model, "side").agg(F.sum(F.coalesce(*parts)).alias("score"))


def proportion_tail_excess(df: DataFrame, score: str = "score", model: str = "model_id") -> DataFrame:
    """Trimmed median, over upper quantiles of the population, of the mixed side's excess beyond them."""
    grid = thresholds(0.70, 0.95, 25)
    qs = [0.70 + 0.25 * i / 24 for i in range(25)]
    found = quantiles(df.filter(F.col("side") == POP), [model], score, {f"q{i}": q for i, q in enumerate(qs)})
    taus = found.select(model, F.array(*[f"q{i}" for i in range(len(qs))]).alias("taus"))
    # a row counts for every threshold it reaches: the taus ascend, so that is a prefix
    slots = df.join(taus, model).select(model, "side", "taus", F.size(F.filter("taus", lambda t: t <= F.col(score))).alias("k"))
    counts = slots.groupBy(model, "k").agg(F.count(on(MIX, F.lit(1))).alias("m"), F.count(on(POP, F.lit(1))).alias("p"))
    marks = df.select(model).distinct().select(model, F.posexplode(grid).alias("i", "q")).select(model, (F.col("i") + 1).alias("k"), "q")
    full = marks.join(counts, [model, "k"], "full").fillna(0, ["m", "p"])
    by = Window.partitionBy(model)
    above = by.orderBy(F.desc("k"))
    pm, pp = F.sum("m").over(above) / F.sum("m").over(by), F.sum("p").over(above) / F.sum("p").over(by)
    est = full.select(model, "k", v.clip((pm - pp) / (1.0 - pp + 1e-8)).alias("e")).filter("k > 0")
    ends = est.groupBy(model).agg(F.percentile("e", 0.2).alias("lo"), F.percentile("e", 0.8).alias("hi"))
    return est.join(ends, model).filter("e >= lo and e <= hi").groupBy(model).agg(F.median("e").alias("proportion"))


def calibrate_by_accuracy(estimates: DataFrame, df: DataFrame, correct: str, model: str = "model_id") -> DataFrame:
    """Three quarters of the estimate and a quarter of the scaled gain in accuracy."""
    gain = df.groupBy(model).agg((F.avg(on(MIX, F.col(correct).cast("double"))) - F.avg(on(POP, F.col(correct).cast("double")))).alias("__g"))
    blended = 0.75 * F.col("proportion") + 0.25 * v.clip(F.greatest(F.col("__g"), F.lit(0.0)) * 3.5)
    return estimates.join(gain, model).withColumn("proportion", v.clip(blended)).drop("__g")


def strongest(a: DataFrame, b: DataFrame, model: str = "model_id") -> DataFrame:
    """The greater of two estimates."""
    return a.join(b.withColumnRenamed("proportion", "__b"), model).withColumn("proportion", F.greatest("proportion", "__b")).drop("__b")


def blend(a: DataFrame, b: DataFrame, share: float = 0.5, model: str = "model_id") -> DataFrame:
    joined = a.join(b.select(model, F.col("proportion").alias("__b")), model)
    return joined.withColumn("proportion", v.clip(share * F.col("proportion") + (1 - share) * F.col("__b"))).drop("__b")


def median_of(df: DataFrame, model: str, signals: list[str]) -> DataFrame:
    """Median of the signals a model has; missing ones are skipped."""
    return df.select(model, F.explode(F.array(*signals)).alias("x")).groupBy(model).agg(F.median("x").alias("proportion"))
