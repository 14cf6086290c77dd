"""Shards cut from a Hilbert curve through metadata space.

Each dimension is quantised to ``2 ** bits`` levels of equal depth in its own
order: the level of a value is the share of rows before it.  The cell of a row
is its tuple of levels; cells are numbered along a Hilbert curve, whose
neighbours are neighbours in every dimension, and rows are ordered by cell, then
by their values, then by a hash of their id.  The order is cut into runs whose
row counts differ by at most one, so a shard spans few cells, and the least and
greatest value of each dimension in a shard exclude it from most lookups.

All of it is DataFrame code.  Rows are counted by their values and one of a
number of hash slots that grows with the table; running totals over those counts
say how many rows come before each such bucket, and only within a bucket rows
are numbered.  So no task sees more than a bucket, however common its values
are, and no text is shuffled.

Rows: null text has size 1 and the checksum of no bytes; a null in a dimension
is a value of its own, before the others; a null id is an id like others;
repeated rows are rows like others;
rows that are equal in everything used here are numbered in any order, which
can't be seen; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, or_null, running_total, utf8

BUCKET_ROWS = 8192  # rows of the table for each hash slot


def hilbert_index(levels: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell given by its levels, each below ``2 ** bits``.

    The levels are turned to the curve's frame from the coarsest bit to the
    finest, Gray-coded, and their bits interleaved.
    """
    n = len(levels)
    turns = ", ".join(f"named_struct('q', {1 << b}L, 'i', {i})" for b in range(bits - 1, 0, -1) for i in range(n))
    halves = ", ".join(f"{1 << b}L" for b in range(bits - 1, 0, -1))
    weave = ", ".join(f"named_struct('b', {b}, 'i', {i})" for b in range(bits - 1, -1, -1) for i in range(n))
    start = F.array(*[level.cast("long") for level in levels])
    turned = start
    if bits > 1:
        turned = F.aggregate(
            F.expr(f"array({turns})"),
            start,
            lambda s, step: F.transform(
                s,
                lambda x, j: F.when(
                    F.get(s, step["i"]).bitwiseAND(step["q"]) != 0, F.when(j == 0, x.bitwiseXOR(step["q"] - 1)).otherwise(x)
                )
                .when(
                    (step["i"] != 0) & ((j == 0) | (j == step["i"])),
                    x.bitwiseXOR(F.get(s, F.lit(0)).bitwiseXOR(F.get(s, step["i"])).bitwiseAND(step["q"] - 1)),
                )
                .otherwise(x),
            ),
        )
    xor = lambda a, b: a.bitwiseXOR(b)
    zero = F.lit(0).cast("long")
    # a chain of one-element arrays stands for "let": each value is computed once
    return F.get(
        F.transform(
            F.transform(F.array(turned), lambda s: F.transform(s, lambda x, j: F.aggregate(F.slice(s, 1, j + 1), zero, xor))),
            lambda s: F.aggregate(
                F.expr(f"array({weave})"),
                zero,
                lambda out, w: F.shiftleft(out, 1).bitwiseOR(
                    F.call_function(
                        "shiftright",
                        F.get(s, w["i"]).bitwiseXOR(
                            F.aggregate(
                                F.expr(f"array({halves})" if bits > 1 else "array(0L)"),
                                zero,
                                lambda t, q: F.when(F.get(s, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
                            )
                        ),
                        w["b"],
                    ).bitwiseAND(F.lit(1))
                ),
            ),
        ),
        F.lit(0),
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32) and the raw dimensions d0 (lang), d1 (source), d2 (size, in eighths of a power of two)."""
    text = utf8(F.col(text_col).cast("string"))
    size = F.octet_length(text).cast("long") + 1
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        or_null(F.col("lang")).alias("d0"),
        or_null(F.col("source")).alias("d1"),
        F.floor(F.log2(size) * 8).cast("int").alias("d2"),
    )


def hilbert_order(rows: DataFrame, dims: list[str], key: list[str], bits: int = 5) -> tuple[DataFrame, int]:
    """``rows`` with ``curve`` and ``rank`` (gapless from 0 in curve order), and their number.

    ``key`` are columns that tell rows apart; they break ties, by hash first.
    """
    rows = cut(rows)
    total = rows.count()
    slots = 1 + total // BUCKET_ROWS
    rows = rows.withColumn("__h", F.xxhash64(*key)).withColumn("__s", F.pmod(F.col("__h"), F.lit(slots)).cast("int"))
    combos = cut(rows.groupBy(*dims).agg(F.count("*").alias("n")))
    cells = combos
    for i, dim in enumerate(dims):
        values = running_total(combos.groupBy(dim).agg(F.sum("n").alias("m")), [dim], "m", "before")
        level = F.floor(F.col("before") * F.lit(1 << bits) / F.lit(max(total, 1))).cast("int")
        cells = cells.join(values.select(dim, F.least(level, F.lit((1 << bits) - 1)).alias(f"__l{i}")), dim)
    cells = cells.withColumn("curve", hilbert_index([F.col(f"__l{i}") for i in range(len(dims))], bits)).select(*dims, "curve")
    buckets = rows.groupBy(*dims, "__s").agg(F.count("*").alias("m")).join(cells, dims)
    before = running_total(buckets, ["curve", *dims, "__s"], "m", "__before")
    within = Window.partitionBy(*dims, "__s").orderBy("__h", *key)
    placed = rows.withColumn("__n", F.row_number().over(within)).join(before.drop("m"), [*dims, "__s"])
    return placed.withColumn("rank", F.col("__before") + F.col("__n") - 1).drop("__h", "__s", "__n", "__before"), total


def cut_runs(ranked: DataFrame, total: int, shards: int = 8) -> DataFrame:
    """Add ``shard`` and ``slot``: runs of ``rank`` whose lengths differ by at most one."""
    shard = F.expr(f"CAST((rank * {shards}) DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(shard * CAST({total} AS BIGINT) + {shards - 1}) DIV {shards}")
    return ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve) of every row."""
    ranked, total = hilbert_order(measured(docs, id_col, text_col), ["d0", "d1", "d2"], ["doc_id", "text_crc32", "size"], bits)
    return cut_runs(ranked, total, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )


def shard_ranges(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Least and greatest value of each column in each shard: what a lookup prunes by."""
    ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), *ends)
