"""Shaping estimates by their rank within a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import clip


def ranked(df: DataFrame, group: str, value: str, key: str) -> DataFrame:
    """``rn``: 1 for the least value of the group; ties go by key."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(value, key)))


def rank_pattern(df: DataFrame, group: str, value: str, key: str, pattern: list[float], name: str = "shaped") -> DataFrame:
    return ranked(df, group, value, key).withColumn(name, F.get(F.array(*map(F.lit, pattern)), F.col("rn") - 1)).drop("rn")


def rank_functions(df: DataFrame, group: str, value: str, key: str, by_rank: list, name: str = "shaped") -> DataFrame:
    """``by_rank``: a function of the value's Column for each rank; the last serves all further ones."""
    shaped = by_rank[-1](F.col(value))
    for i in range(len(by_rank) - 2, -1, -1):
        shaped = F.when(F.col("rn") == i + 1, by_rank[i](F.col(value))).otherwise(shaped)
    return ranked(df, group, value, key).withColumn(name, shaped).drop("rn")


def override_greatest(df: DataFrame, group: str, value: str, key: str, with_: float, name: str = "shaped") -> DataFrame:
    last = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(value), F.desc(key))) == 1
    return df.withColumn(name, F.when(last, F.lit(with_)).otherwise(F.col(value)))


def snap(value: Column, grid: list[float]) -> Column:
    """The nearest grid value, the first on a tie."""
    return F.array_min(F.transform(F.array(*map(F.lit, grid)), lambda g, i: F.struct(F.abs(g - value).alias("d"), i.alias("i"), g.alias("g"))))["g"]


def minimum_gap(df: DataFrame, group: str, value: str, key: str, gap: float, name: str = "shaped") -> DataFrame:
    """Values raised so that each is at least ``gap`` above the one before it in rank, then clipped.

    Raising one after another equals the running maximum of value - gap * rank,
    put back on the slope.
    """
    upto = Window.partitionBy(group).orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    raised = F.max(F.col(value) - gap * F.col("rn")).over(upto) + gap * F.col("rn")
    return ranked(df, group, value, key).withColumn(name, clip(raised)).drop("rn")


def soft_snap(df: DataFrame, group: str, value: str, key: str, prior: str, anchors: list[float], name: str = "shaped") -> DataFrame:
    """Seven tenths the rank's anchor and three tenths twice the value, then halfway to the prior."""
    anchor = F.get(F.array(*map(F.lit, anchors)), F.col("rn") - 1)
    snapped = 0.70 * anchor + 0.30 * (F.col(value) * 2.0)
    return ranked(df, group, value, key).withColumn(name, clip(0.5 * snapped + 0.5 * F.col(prior))).drop("rn")


def power_normalise(df: DataFrame, value: str, power: float = 1.35, low: float = 0.001, high: float = 0.95, name: str = "shaped") -> DataFrame:
    """Values above the least, to a power, as shares, clipped and made shares again.

    The least value and the sums are one-row aggregates joined back.
    """
    least = F.broadcast(df.agg(F.min(value).alias("__min")))
    raised = df.crossJoin(least).withColumn("__p", F.pow(F.col(value) - F.col("__min") + 1e-12, F.lit(power)))
    clipped = raised.crossJoin(F.broadcast(raised.agg(F.sum("__p").alias("__s")))).withColumn("__c", clip(F.col("__p") / (F.col("__s") + 1e-12), low, high))
    out = clipped.crossJoin(F.broadcast(clipped.agg(F.sum("__c").alias("__t"))))
    return out.withColumn(name, F.col("__c") / F.col("__t")).drop("__min", "__p", "__s", "__c", "__t")


def push(value: Column, amount: float, cap: float) -> Column:
    return F.least(value + amount, F.lit(cap))


def monotone_violations(df: DataFrame, group: str, order: str, value: str, eps: float = 1e-9) -> DataFrame:
    """(group, n_violations): how often a value falls below the one before it."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("__b", before).groupBy(group).agg(F.count_if(F.col(value) + eps < F.col("__b")).alias("n_violations"))
