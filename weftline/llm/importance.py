"""Draw documents that look like a target set: importance weights over hashed word runs, Gumbel noise, an exact cut.

Every run of one to three words falls into one of ``buckets`` by its checksum.
Counts of all buckets over all documents and over the whole target set give each
bucket a gain, and a document's weight is the sum of the gains of its runs.  The
counts have a bounded length, so they are added up by tasks first, and the table
of gains that the second scan looks up is as short.

The draw needs no sort of the documents: eligible ones are counted by integer
score, the counts are summed from the top over ranges of scores, the score at
which the sum reaches the wanted number is the cut, and only the documents from
there on are numbered, by id within each score.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from ._shared import cut, running_total

BUCKETS = 10_000
LONGEST = 3


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """(bucket, n): runs of each bucket over all texts; a task sends one row a bucket."""

    def run(batches):
        held = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for piece in words.pieces(batch.column(0), longest - 1):
                for _, crc in words.run_checksums(piece, longest):
                    held += np.bincount(crc % buckets, minlength=buckets)
        there = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(held[there], pa.int64())], ["bucket", "n"])

    found = texts.select(text).mapInArrow(run, "bucket int, n bigint")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the source, each count raised by one."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for held, counts in ((s, source), (t, target)):
        for row in counts.collect():  # a row for each bucket at most
            held[row.bucket] = row.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(key, n_words, n_features, weight) of every document."""
    buckets = len(gain)
    shared = docs.sparkSession.sparkContext.broadcast(gain.astype(np.float64))

    def run(batches):
        gain = shared.value  # noqa: F823
        for batch in batches:
            n = len(batch)
            n_words, n_features, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n)
            for piece in words.pieces(batch.column(1), longest - 1):
                n_words += np.bincount(piece.row[piece.new :], minlength=n)
                for row, crc in words.run_checksums(piece, longest):
                    n_features += np.bincount(row, minlength=n)
                    weight += np.bincount(row, gain[crc % buckets], n)  # whole numbers far below 2**53
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight.astype(np.int64))], [key, "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(key: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number g that the seed and the id decide; a null id counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, wanted: int, key: str = "doc_id", score: str = "score") -> DataFrame:
    """Add ``rank`` from 1 on to the ``wanted`` rows of highest score, ties to the smaller id; null for all others.

    Only rows where ``eligible`` is true are drawn.  ``scored`` should be cheap
    to read again: it is read three times.
    """
    whole = scored.columns
    counts = scored.filter("eligible").groupBy(score).agg(F.count("*").alias("__n")).withColumn("__down", -F.col(score))
    offsets = running_total(counts, ["__down"], "__n", "__above").filter(F.col("__above") < wanted).select(F.col(score).alias("__s"), "__above")
    offsets = cut(offsets)
    lowest = offsets.agg(F.min("__s")).first()[0]
    none = F.lit(None).cast("bigint").alias("rank")
    if lowest is None:
        return scored.select(*whole, none)
    over = F.col("eligible") & (F.col(score) >= lowest)
    tied = [c for c in whole if c not in (key, score)]  # a repeated id: the order is fixed by what else tells rows apart
    within = F.row_number().over(Window.partitionBy(score, "__above").orderBy(key, *tied))
    top = scored.filter(over).join(offsets, F.col(score) == F.col("__s")).withColumn("__r", F.col("__above") + within)
    ranked = top.select(*whole, F.when(F.col("__r") <= wanted, F.col("__r")).cast("bigint").alias("rank"))
    return ranked.unionByName(scored.filter(~over).select(*whole, none))


def importance(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``docs``.

    Null texts and texts without words have no features and weight 0.  Rows that
    repeat an id are rows of their own with the same noise; ranks tell them
    apart.  An empty table gives an empty one; an empty target gives every
    bucket the gain of a count of nothing.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets), buckets)
    weighed = weigh(docs, gain, key, text)
    scored = cut(weighed.select(key, "n_features", "weight", (F.col("weight") + noise(F.col(key), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible")))
    wanted = percent * scored.filter("eligible").count() // 100
    return draw(scored, wanted, key).select(key, "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The drawn documents, with all their columns; ids should tell documents apart."""
    drawn = importance(docs, target, key, **how).filter("rank is not null").select(key)
    return docs.join(drawn, key, "left_semi").select(*docs.columns)


# --- the same in SQL -----------------------------------------------------------

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql(percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> str:
    """DuckDB: checksums by a list of 256 remainders, folded over the bytes of every different run."""
    table = reduce(lambda c, _: f"list_transform({c}, lambda x: xor(x // 2, (x % 2) * 3988292384))", range(8), "range(256)")
    return f"""WITH w AS MATERIALIZED (SELECT 0 AS side, doc_id AS id, {_WORDS} AS w FROM documents UNION ALL SELECT 1, item_id, {_WORDS} FROM benchmark),
f AS MATERIALIZED (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat_ws(' ', w[i], w[i + 1])),
  list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))) AS g FROM w),
d AS MATERIALIZED (SELECT g, sum(1 - side)::BIGINT AS s, sum(side)::BIGINT AS t FROM f GROUP BY g),
c AS (SELECT {table} AS c),
x AS MATERIALIZED (SELECT g, s, t, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(g)), '..'), lambda h: ('0x' || h)::BIGINT),
  lambda a, b: xor(a // 256, c[xor(a % 256, b) + 1]), 4294967295::BIGINT)) % {buckets} AS b FROM d, c),
k AS (SELECT b, sum(s) AS s, sum(t) AS t FROM x GROUP BY b), z AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM k),
q AS (SELECT b, floor(1000::DOUBLE * ln((k.t + 1)::DOUBLE * (z.s + {buckets}) / ((k.s + 1)::DOUBLE * (z.t + {buckets}))))::BIGINT AS gain FROM k, z),
v AS (SELECT id, count(*) AS n, sum(gain) AS weight FROM f JOIN x USING (g) JOIN q USING (b) WHERE side = 0 GROUP BY id),
r AS (SELECT w.id, len(w.w) >= {least_words} AS ok, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  ('0x' || sha256('{seed}:' || w.id)[1:8])::BIGINT AS h FROM w LEFT JOIN v USING (id) WHERE side = 0),
o AS (SELECT *, weight + floor(-1000::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY score DESC, id) AS place, count(*) OVER (PARTITION BY ok) AS n FROM o)
SELECT id AS doc_id, n_features, weight, score, CASE WHEN ok AND place <= {percent} * n // 100 THEN place END::BIGINT AS rank FROM p"""
