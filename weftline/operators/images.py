"""Images as flattened arrays: resizing, the order of axes, and scales that the data decide."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def triangle_weights(size: int, wanted: int) -> list[tuple[int, list[float]]]:
    """(first place, weights) of each output place: linear interpolation, over a support that grows with the reduction.

    Weights of an output place add up to one; at the borders the support is cut.
    """
    scale = size / wanted
    reach = max(scale, 1.0)
    out = []
    for i in range(wanted):
        centre = (i + 0.5) * scale
        first, last = max(0, math.floor(centre - reach + 0.5)), min(size, math.floor(centre + reach + 0.5))
        raw = [max(0.0, 1.0 - abs((x + 0.5 - centre) / reach)) for x in range(first, last)]
        out.append((first, [w / sum(raw) for w in raw]))
    return out


def _tables(size: int, wanted: int) -> tuple[Column, Column]:
    found = triangle_weights(size, wanted)
    return F.array(*[F.lit(f) for f, _ in found]), F.array(*[F.array(*map(F.lit, w)) for _, w in found])


def _along(array: Column, before: int, size: int, after: int, wanted: int) -> Column:
    """Interpolate the middle axis of an array of shape (before, size, after) to ``wanted`` places."""
    first, weights = _tables(size, wanted)

    def value(k: Column) -> Column:
        row, at, rest = F.floor(k / (wanted * after)).cast("int"), F.floor(k / after).cast("int") % wanted, k % after
        start = (row * size + F.get(first, at)) * after + rest
        terms = F.transform(F.get(weights, at), lambda w, i: w * F.get(array, start + i * after))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return F.transform(F.sequence(F.lit(0), F.lit(before * wanted * after - 1)), value)


def resized(df: DataFrame, image: str, name: str, height: int, width: int, new_height: int, new_width: int, channels: int = 1) -> DataFrame:
    """``df`` with ``name``: flattened (height, width, channels) images, bilinearly resized; rows first, then columns, each pixel a sum of a few weighted ones.

    Null arrays and those of another length give null.
    """
    there = F.size(image) == height * width * channels
    across = df.withColumn("__across", F.when(there, _along(F.col(image), height, width, channels, new_width)))
    # held in an array of one element: the optimiser doesn't put the first pass into the second's loop
    held = F.transform(F.array("__across"), lambda a: _along(a, 1, height, new_width * channels, new_height))
    return across.withColumn(name, F.when(F.col("__across").isNotNull(), F.get(held, F.lit(0)))).drop("__across")


def channels_first(array: Column, height: int, width: int, channels: int) -> Column:
    """A flattened (height, width, channels) array as (channels, height, width)."""
    n = height * width
    return F.transform(F.sequence(F.lit(0), F.lit(n * channels - 1)), lambda k: F.get(array, (k % n) * channels + F.floor(k / n).cast("int")))


def normalised(df: DataFrame, keys: list[str], image: str, shape: tuple[int, int, int], means: list[float], stds: list[float], name: str = "x", most: float = 2.0, levels: float = 255.0) -> DataFrame:
    """``df`` with ``name``: images of each set (``keys``) on a common scale, channels first, standardised by channel.

    A set whose greatest component over all its images is above ``most`` counts
    as levels and is divided by ``levels``.  Images of ``shape`` (h, w, 3) have
    their channels moved to the front; one of (3, h, w) has them there.  The
    greatest components, a row for each set, are joined back to the images.
    """
    a, b, c = shape
    last = c == len(means)
    if not last and a != len(means):
        raise ValueError("neither the first nor the last axis has a place for each channel")
    tops = df.groupBy(*keys).agg(F.max(F.array_max(image)).alias("__top"))
    known = [F.col(f"__k{i}") for i in range(len(keys))]
    tops = tops.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__top")
    same = F.lit(True)
    for k, other in zip(keys, known):
        same = same & F.col(k).eqNullSafe(other)
    met = df.join(tops, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])
    moved = channels_first(F.col(image), a, b, c) if last else F.col(image)
    n = a * b if last else b * c
    m, s = F.array(*map(F.lit, means)), F.array(*map(F.lit, stds))
    scale = F.when(F.col("__top") > most, levels).otherwise(1.0)
    out = F.transform(moved, lambda x, i: (x.cast("double") / scale - F.get(m, F.floor(i / n).cast("int"))) / F.get(s, F.floor(i / n).cast("int")))
    return met.withColumn(name, F.when(F.size(image) == a * b * c, out)).drop("__top")
