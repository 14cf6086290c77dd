"""Running sums, positions and exact quantiles over an order, without one task that sees all of a group.

Rows fall into slots between splitters that a mergeable sketch of the values
gives, so slots hold about as many rows each wherever the values lie; equal
values share a slot.  Slots are summed up first; only within a slot rows are
ordered.  Quantiles of groups too large for one aggregation need no order of all
rows: the same sketch, by group, gives bounds between which each quantile must
lie; what is below is counted, and only what is between is ordered.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOTS = 512
ACCURACY = 10_000  # ranks of the sketch are right to this share of the rows
GROUPS = 100_000  # what has a row for each of so many groups is held by the driver and broadcast
WHOLE = 200_000  # rows of a group that one aggregation may hold


def splitters(df: DataFrame, value: str, slots: int = SLOTS) -> list[float]:
    """Increasing numbers that cut the values of a column into about equal parts."""
    found = df.select(F.col(value).cast("double").alias("__v")).filter("__v is not null and not isnan(__v)")
    cuts = found.agg(F.percentile_approx("__v", [i / slots for i in range(1, slots)], 4 * slots)).first()[0]
    return sorted({x for x in cuts or [] if abs(x) != float("inf")})


def slotted(df: DataFrame, value: str, name: str, cuts: list[float]) -> DataFrame:
    """Add ``name``, a whole number that doesn't fall where the value grows: nulls first, NaN last."""
    if not cuts:
        at = F.when(F.isnan("__v"), 1).otherwise(0)
        return df.withColumn("__v", F.col(value).cast("double")).withColumn(name, F.when(F.col("__v").isNull(), -1).otherwise(at)).drop("__v")
    placed = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__v", outputCol="__b", handleInvalid="keep")
    marked = placed.transform(df.withColumn("__v", F.col(value).cast("double")))
    return marked.withColumn(name, F.when(F.col("__v").isNull(), -1).otherwise(F.col("__b").cast("int"))).drop("__v", "__b")


def running_sums(df: DataFrame, keys: list[str], order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Add ``run_*``, the sums up to and with each row in ``order`` within ``keys``, and ``all_*``, those of all its rows.

    Rows of one order value should be one row, as after an aggregation.
    """
    toward = F.desc if descending else F.asc
    marked = slotted(df, order, "__slot", splitters(df, order))
    totals = marked.groupBy(*keys, "__slot").agg(*[F.sum(c).alias(c) for c in sums])
    by = Window.partitionBy(*keys)
    before = by.orderBy(toward("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__slot").alias("__s"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in sums],
        *[F.sum(c).over(by).alias(f"all_{c}") for c in sums],
    )
    same = F.col("__slot") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = Window.partitionBy(*keys, "__slot").orderBy(toward(order)).rowsBetween(Window.unboundedPreceding, 0)
    runs = [(F.col(f"__before_{c}") + F.sum(c).over(within)).alias(f"run_{c}") for c in sums]
    return marked.join(starts, same).select(*df.columns, *runs, *[f"all_{c}" for c in sums])


def few(df: DataFrame) -> DataFrame | None:
    """The rows of a table of groups, computed once and marked for broadcast; None if there are more than ``GROUPS``."""
    rows = df.limit(GROUPS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= GROUPS else None


def _bounds(rows: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """(keys, n, bounds): an array of (low, high) that holds both neighbours of each quantile; nulls where a group is small enough to take all of it."""
    margin = 4 / ACCURACY
    asked = [x for q in shares for x in (max(0.0, q - margin), min(1.0, q + margin))]
    found = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__v", asked, ACCURACY).alias("__p"))
    pairs = F.array(*[F.struct(*[F.when(F.col("__n") > ACCURACY, F.get("__p", F.lit(2 * i + j))).alias(side) for j, side in enumerate(("low", "high"))]) for i in range(len(shares))])
    bounds = found.select(*keys, "__n", pairs.alias("__bounds"))
    held = few(bounds)
    return bounds if held is None else held


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each share): exact quantiles with linear interpolation; nulls are left out, NaN is the greatest.

    Which way is taken depends on the largest group; the result doesn't.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).filter("__v is not null")
    names = list(shares)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] or 0
    if sizes <= WHOLE:
        found = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile("__v", [float(shares[n]) for n in names]).alias("__q"))
        return found.filter("__n > 0").select(*keys, *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    bounds = _bounds(rows, keys, [float(shares[n]) for n in names])
    other = bounds.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n", "__bounds")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))

    def cell(i: int):
        low, high = F.get("__bounds", F.lit(i))["low"], F.get("__bounds", F.lit(i))["high"]
        under = F.coalesce(F.col("__v") < low, F.lit(False))
        inside = ~under & F.coalesce(F.col("__v") <= high, F.lit(True))
        return F.when(under | inside, F.struct(F.lit(i).alias("i"), inside.alias("inside"), F.when(inside, F.col("__v")).alias("v")))

    cells = F.filter(F.array(*[cell(i) for i in range(len(names))]), lambda c: c.isNotNull())
    counts = rows.join(other, same).select(*keys, "__n", F.explode(cells).alias("__c")).groupBy(*keys, "__n", "__c.i", "__c.inside", "__c.v").agg(F.count("*").alias("__m"))
    up_to = F.sum("__m").over(Window.partitionBy(*keys, "i").orderBy("inside", "v"))
    place = F.get(F.array(*[F.lit(float(shares[n])) for n in names]), F.col("i")) * (F.col("__n") - 1)
    at = lambda x: (x >= F.col("__to") - F.col("__m")) & (x < F.col("__to"))
    held = counts.withColumn("__to", up_to).filter("inside").select(*keys, "i", "v", at(F.floor(place)).alias("__low"), at(F.ceil(place)).alias("__high"), (place - F.floor(place)).alias("__part"))
    side = lambda i, c: F.max(F.when((F.col("i") == i) & F.col(c), F.col("v")))
    part = lambda i: F.max(F.when(F.col("i") == i, F.col("__part")))
    value_of = lambda i: side(i, "__low") + F.when(part(i) == 0, 0.0).otherwise(part(i) * (side(i, "__high") - side(i, "__low")))
    return held.filter("__low or __high").groupBy(*keys).agg(*[value_of(i).alias(n) for i, n in enumerate(names)])


def positions(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Add ``name``: the place of each row, from 0, in the order of a number within ``keys``."""
    marked = slotted(df, order, "__slot", splitters(df, order))
    sizes = marked.groupBy(*keys, "__slot").agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__slot").alias("__s"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    same = F.col("__slot") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    within = F.row_number().over(Window.partitionBy(*keys, "__slot").orderBy(order)) - 1
    return marked.join(starts, same).select(*df.columns, (F.col("__start") + within).alias(name))
