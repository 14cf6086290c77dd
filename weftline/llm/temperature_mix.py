"""Mixing sources by temperature.

A source's share of all tokens is raised to an exponent and normalised.  One is
the natural mixture, zero the uniform one; the exponent is bisected to the
smallest, that is the flattest mixture, which keeps to the limit on repetition
and doesn't exceed the target entropy.  Entropy falls and repetition falls as
the exponent grows, so both bounds are one crossing each.  Every step of the
bisection evaluates a row of candidates in one aggregation over the sources.

The weights are then realised within a token budget.  The documents of a source
are dealt into blocks by hash.  An epoch of the source is a permutation of its
blocks; its budget buys whole epochs, and the rest of it the first blocks of one
more permutation, up to a document of the block where the budget ends.  By
default the budget is the least that takes every document once, so nothing is
left out, and small sources are repeated up to the limit.

All of it is DataFrame code.  What is joined to documents are tables of sources
and of their blocks: broadcast where their counted rows are few, so that
documents stay where they are, else shuffled, with skewed keys split at run time.

Tokens of a text are estimated at four bytes each, one at least.

Rows: null text has one token; a null source is a source of its own; repeated
rows are rows like others, ordered alike, so both are in or out; null ids count
as one id; an empty table gives an empty table; columns of any name are carried
on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import beside, counted, cut, fresh, masked, utf8

SEED = 20240
STEPS, POINTS = 4, 32  # the exponent is found to 32 ** -4


def source_totals(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, tokens, n_docs) of every source."""
    return _with_tokens(docs, source_col, text_col).groupBy("__source").agg(
        F.sum("__tokens").alias("tokens"), F.count("*").alias("n_docs")
    )


def _with_tokens(docs: DataFrame, source_col: str, text_col: str) -> DataFrame:
    tokens = F.greatest(F.ceil(F.octet_length(utf8(F.col(text_col).cast("string"))) / 4), F.lit(1)).cast("long")
    return docs.withColumn("__source", F.coalesce(F.col(source_col).cast("string"), F.lit(""))).withColumn("__tokens", tokens)


def bisect_exponent(totals: DataFrame, max_repeats: float, entropy_share: float) -> float:
    """The least exponent in [0, 1] under which no source is repeated more than ``max_repeats``
    times as often as the least repeated one, and the mixture's entropy is at most ``entropy_share``
    of the uniform mixture's."""
    whole = totals.agg(F.sum("tokens"), F.count("*"), F.min("tokens"), F.max("tokens")).first()
    if not whole[0] or whole[1] < 2:
        return 1.0
    log_share = F.log(F.col("tokens") / F.lit(float(whole[0])))
    widest = math.log(whole[3] / whole[2])
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        points = [low + (high - low) * (i + 1) / POINTS for i in range(POINTS - 1)]
        parts = [f(log_share, a) for a in points for f in (lambda x, a: F.sum(F.exp(x * a)), lambda x, a: F.sum(F.exp(x * a) * x * a))]
        sums = totals.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]).first()
        fits = []
        for i, a in enumerate(points):
            z, zx = sums[2 * i], sums[2 * i + 1]
            entropy = math.log(z) - zx / z
            fits.append(math.exp((1 - a) * widest) <= max_repeats and entropy <= entropy_share * math.log(whole[1]) + 1e-12)
        first = next((i for i, fit in enumerate(fits) if fit), len(points))
        low, high = (points[first - 1] if first else low), (points[first] if first < len(points) else high)
    return high


def mixture(totals: DataFrame, max_repeats: float = 2.0, entropy_share: float = 0.97, budget: int | None = None) -> DataFrame:
    """(source, tokens, n_docs, weight, repeats): target weight and how often the budget takes each document."""
    exponent = bisect_exponent(totals, max_repeats, entropy_share)
    powered = totals.withColumn("__p", F.pow(F.col("tokens").cast("double"), F.lit(exponent)))
    z = powered.agg(F.sum("__p"), F.max(F.col("tokens") / F.col("__p"))).first()
    weight = F.col("__p") / F.lit(z[0] or 1.0)
    tokens = F.lit(float(budget)) if budget is not None else F.lit((z[1] or 0.0) * (z[0] or 0.0))
    repeats = F.round(weight * tokens / F.col("tokens"), 9)
    return powered.withColumn("weight", weight).withColumn("repeats", repeats).drop("__p")


def mix(
    docs: DataFrame,
    max_repeats: float = 2.0,
    entropy_share: float = 0.97,
    budget: int | None = None,
    block_tokens: int = 1 << 16,
    max_blocks: int = 1 << 14,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """A row for each time that a document is taken.

    Added columns: ``__tokens``, ``__epoch``, ``__block``, and ``__turn``, by
    which the blocks of a source follow one another within an epoch; with more
    underscores in front where the table has a column of that name.
    """
    names = docs.columns
    docs, new, restore = masked(docs)
    id_col, source_col, text_col = new[id_col], new[source_col], new[text_col]
    docs = _with_tokens(docs, source_col, text_col)
    totals = cut(docs.groupBy("__source").agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("n_docs")))
    blocks_of = F.least(F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)), F.lit(max_blocks)).cast("int")
    plan = (
        mixture(totals, max_repeats, entropy_share, budget)
        .withColumn("__blocks", blocks_of)
        .withColumn("__full", F.floor("repeats").cast("int"))
        .withColumn("__rest", (F.col("repeats") - F.floor("repeats")) * F.col("tokens"))
        .select("__source", "__blocks", "__full", "__rest")
    )
    plan, n_sources = counted(plan)
    key = F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"))
    dealt = docs.join(beside(plan, n_sources), "__source").withColumn("__block", F.pmod(key, F.col("__blocks")).cast("int"))
    turn = lambda epoch: F.xxhash64(F.lit(SEED), F.col("__source"), F.col("__block"), epoch)
    within = F.xxhash64(F.lit(SEED + 1), F.col(id_col).cast("string"), F.col("__full"))
    # the last, partial epoch: which blocks are in whole, and where it ends
    partial = dealt.filter("__rest > 0")
    running = Window.partitionBy("__source").orderBy("__turn", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut(
        partial.groupBy("__source", "__block", "__full", "__rest")
        .agg(F.sum("__tokens").alias("__sum"))
        .withColumn("__turn", turn(F.col("__full")))
        .withColumn("__before", F.coalesce(F.sum("__sum").over(running), F.lit(0)))
        .filter("__before < __rest")
        .withColumn("__left", F.col("__rest") - F.col("__before"))
        .select("__source", "__block", "__sum", "__left")
    )
    last = blocks.filter("__sum > __left").select("__source", "__block", "__left")
    inside = Window.partitionBy("__source").orderBy("__within").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        partial.join(beside(last, n_sources), ["__source", "__block"])
        .withColumn("__within", within)
        .select("__source", "__block", "__within", "__tokens", "__left")
        .withColumn("__before", F.coalesce(F.sum("__tokens").over(inside), F.lit(0)))
        .filter("__before < __left")
        .groupBy("__source", "__block")
        .agg(F.max("__within").alias("__end"))
    )
    taken, n_blocks = counted(blocks.join(ends, ["__source", "__block"], "left").select("__source", "__block", F.lit(1).alias("__in"), "__end"))
    more = F.when(F.col("__in").isNotNull() & (F.col("__end").isNull() | (within <= F.col("__end"))), 1).otherwise(0)
    rows = (
        dealt.join(beside(taken, n_blocks), ["__source", "__block"], "left")
        .withColumn("__copies", F.col("__full") + more)
        .filter("__copies > 0")
        .withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
        .withColumn("__turn", turn(F.col("__epoch")))
    )
    return restore(rows, *[F.col(c).alias(fresh(names, c)) for c in ("__tokens", "__epoch", "__block", "__turn")])
