"""Folds, ROC curves, metrics, and rule tables that say what is wrong with an output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sums


def hash_order(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def hash_positions(df: DataFrame, keys: list[str], order: Column, key: str, name: str) -> DataFrame:
    """Add ``name``: the place of each row, from 0, within ``keys``, in the order of a hash in hex, then of ``key``.

    Rows are numbered within 4,096 ranges of the hash; the ranges' sizes say
    where each begins.  So no task has to order all rows of a key.
    """
    part = F.substring(order, 1, 3)
    sizes = df.groupBy(*keys, part.alias("__part")).agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__start"))
    marked = df.withColumn("__order", order).withColumn("__part", F.substring("__order", 1, 3))
    within = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__order", key)) - 1
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    numbered = marked.withColumn("__within", within).join(starts, same)
    return numbered.select(*df.columns, (F.col("__start") + F.col("__within")).alias(name))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold``: rows of each label dealt in turn, in the order of a hash of seed and key."""
    placed = hash_positions(df, [label], hash_order(str(seed), key), key, "__place")
    return placed.withColumn("fold", (F.col("__place") % k).cast("int")).drop("__place")


def hash_bucket(key: Column, n: int = 100) -> Column:
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % n).cast("int")


def roc_points(df: DataFrame, label: str, score: str, group: str | None = None) -> DataFrame:
    """(group, score, fp, tp, f, t): counts at or above each distinct score, and those at it.

    Ties are grouped first; the running sums are over distinct scores, spread over slots of them.
    """
    keys = [group] if group else []
    y = F.col(label).cast("int")
    steps = df.groupBy(*keys, score).agg(F.sum(1 - y).alias("f"), F.sum(y).alias("t"))
    run = running_sums(steps, keys, score, ["f", "t"], descending=True)
    return run.select(*keys, score, F.col("run_f").alias("fp"), F.col("run_t").alias("tp"), "f", "t")


def _totals(points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` beside the counts of all rows, as nf and nt."""
    ends = points.groupBy(*keys).agg(F.max("fp").alias("nf"), F.max("tp").alias("nt"))
    return points.join(ends, keys) if keys else points.crossJoin(F.broadcast(ends))


def tpr_at_fpr(points: DataFrame, target: float = 0.01, drop_intermediate: bool = False, group: str | None = None) -> DataFrame:
    """(group, tpr): the highest rate of true positives while that of false ones is at most ``target``; 0 with one class.

    ``drop_intermediate`` leaves out points on a straight run, whose removal can
    lower the result where tied scores hold both classes; it needs the points of
    a group in one task.
    """
    keys = [group] if group else []
    p = _totals(points.select(*keys, "fp", "tp"), keys)
    if drop_intermediate:
        run = Window.partitionBy(*keys).orderBy("fp", "tp")
        bend = lambda c: (F.lead(c).over(run) - F.col(c)) - (F.col(c) - F.lag(c).over(run))
        p = p.withColumn("__a", bend("fp")).withColumn("__b", bend("tp"))
        p = p.filter(F.col("__a").isNull() | F.col("__b").isNull() | (F.col("__a") != 0) | (F.col("__b") != 0))
    rate = F.when((F.col("nf") == 0) | (F.col("nt") == 0), 0.0).otherwise(F.when(F.col("fp") / F.nullif(F.col("nf"), F.lit(0)) <= target, F.col("tp") / F.nullif(F.col("nt"), F.lit(0))))
    return p.groupBy(*keys).agg(F.coalesce(F.max(rate), F.lit(0.0)).alias("tpr"))


def auc(points: DataFrame, group: str | None = None) -> DataFrame:
    """(group, auc): area under the points by trapezoids, which gives ties half."""
    keys = [group] if group else []
    step = F.col("f") * (F.col("tp") - F.col("t") / 2.0)
    return points.groupBy(*keys).agg((F.sum(step) / (F.max("fp") * F.max("tp"))).alias("auc"))


def log_loss_and_accuracy(df: DataFrame, label: str, prob: str, group: str | None = None, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    loss = -F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))
    right = ((F.col(prob) > 0.5).cast("int") == F.col(label)).cast("double")
    return df.groupBy(*([group] if group else [])).agg(F.avg(loss).alias("logloss"), F.avg(right).alias("accuracy"))


def mean_absolute_error(df: DataFrame, truth: str, estimate: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(truth) - F.col(estimate))).alias("mae"))


# --- rule tables -------------------------------------------------------------


def _rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations) of rules that look at one row each, in one pass."""
    counts = df.agg(F.array(*[F.struct(F.lit(r).alias("rule"), F.count_if(F.coalesce(c, F.lit(False))).alias("n_violations")) for r, c in rules.items()]).alias("r"))
    return counts.select(F.explode("r").alias("r")).select("r.*")


def _count(df: DataFrame, rule: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_violations")).select(F.lit(rule).alias("rule"), "n_violations")


def validate_scores(df: DataFrame, expected: DataFrame, id_col: str = "id", score_col: str = "score") -> DataFrame:
    """(rule, n_violations) of a table of scores: columns, duplicate, missing and extra ids, and values."""
    header = df.sparkSession.range(1).select(F.lit("header").alias("rule"), F.lit(int(df.columns != [id_col, score_col])).cast("long").alias("n_violations"))
    s = F.col(score_col)
    finite = ~F.isnan(s) & (F.abs(s) != float("inf"))
    values = _rules(df, {"nan": s.isNull() | F.isnan(s), "infinite": F.abs(s) == float("inf"), "range": finite & ~s.between(0, 1)})
    ids, want = df.select(id_col), expected.select(F.col(expected.columns[0]).alias(id_col))
    repeated = ids.groupBy(id_col).count().filter("count > 1")
    parts = [
        header, values, _count(repeated, "duplicate_id"), _count(want.join(ids, id_col, "left_anti"), "missing_id"),
        _count(ids.join(want, id_col, "left_anti"), "extra_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


MOST_BYTES = 10 << 20


def validate_score_file(spark, path: str, expected: DataFrame, id_col: str = "id", score_col: str = "score") -> DataFrame:
    """``validate_scores`` of a CSV file, with the rules that look at the file: its ending, and its size of 10 MiB at most."""
    about = spark.read.format("binaryFile").load(path).select(F.lower("path").alias("p"), "length")
    files = about.agg(F.count_if(~F.col("p").endswith(".csv")).alias("extension"), F.count_if(F.col("length") > MOST_BYTES).alias("size"))
    of_file = files.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_violations")) for r in ("extension", "size")])).alias("r")).select("r.*")
    table = spark.read.option("header", True).csv(path)
    if table.columns != [id_col, score_col]:
        header = spark.range(1).select(F.lit("header").alias("rule"), F.lit(1).cast("long").alias("n_violations"))
        return of_file.unionByName(header)
    typed = table.select(F.col(id_col).try_cast("long").alias(id_col), F.coalesce(F.col(score_col).try_cast("double"), F.lit(float("nan"))).alias(score_col))
    return of_file.unionByName(validate_scores(typed, expected, id_col, score_col))


def validate_predictions(df: DataFrame, id_col: str = "id", kind: str = "pii_type", pred: str = "pred", rows: int | None = None, kinds=("CREDIT", "EMAIL", "PHONE")) -> DataFrame:
    """(rule, n_violations) of a table of predictions by id and type."""
    p = F.col(pred)
    n = F.length(p)
    values = _rules(df, {"null": p.isNull(), "empty": F.trim(p) == "", "length": ~n.between(10, 100), "kind": ~F.col(kind).isin(*kinds) | F.col(kind).isNull()})
    pairs = df.groupBy(id_col, kind).count().filter("count > 1")
    sets = df.groupBy(id_col).agg(F.sort_array(F.collect_set(kind)).alias("s")).filter(F.col("s") != F.array(*map(F.lit, sorted(kinds))))
    parts = [values, _count(pairs, "duplicate_pair"), _count(sets, "kinds_of_id")]
    if rows is not None:
        parts.append(df.agg((F.abs(F.count("*") - rows)).alias("n_violations")).select(F.lit("rows").alias("rule"), "n_violations"))
    return reduce(DataFrame.unionByName, parts)


def set_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, key): keys in one table only."""
    only = lambda x, y, s: x.select(key).distinct().join(y.select(key), key, "left_anti").select(F.lit(s).alias("side"), key)
    return only(a, b, "left").unionByName(only(b, a, "right"))
