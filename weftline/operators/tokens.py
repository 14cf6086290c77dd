"""Summaries of per-token values: arrays in rows (id, logp, entropy, rank), or a row for each token (id, pos, logp, entropy, rank).

The values are those of any language model, or of a stand-in that needs none:
``unigram_arrays``, which looks words up where the texts lie, or ``unigram_tokens``,
a row for each word.  Summaries work within the row, on arrays in the order of
the tokens; ``token_arrays`` makes these from rows for each token, in one
shuffle, and the summaries take either.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import let

WINDOW = 16
PERCENTS = (0.10, 0.25, 0.50, 0.75, 0.90)
HEAD_WORDS = 100_000  # words of a vocabulary that are broadcast to a join
TABLE_WORDS = 1_000_000  # words of the table that tasks look up, some 40 MB


def unigram_tokens(docs: DataFrame, words: Column, key: str = "doc_id") -> DataFrame:
    """(key, pos, word, logp, entropy, rank): each word with the corpus' log-frequency and frequency rank.

    A stand-in for a language model's output that needs no model.  The entropy
    is the word's own term -p ln p.  Ranks come from a window over the
    vocabulary's counts, of which equal ones share a row.  The commonest words,
    ``HEAD_WORDS`` of them at most, meet their tokens by broadcast, so no common
    word is a hot key; only tokens of rarer words are shuffled by word.
    """
    long = docs.select(key, F.posexplode(words).alias("pos", "word"))
    counts = long.groupBy("word").agg(F.count("*").alias("c"))
    levels = counts.groupBy("c").agg(F.count("*").alias("m"))
    above = F.coalesce(F.sum("m").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(F.col("c") * F.col("m")).over(Window.partitionBy())
    levels = levels.select("c", (above + 1).alias("rank"), (F.log(F.col("c") / total)).alias("logp"), (-(F.col("c") / total) * F.log(F.col("c") / total)).alias("entropy"))
    known = counts.join(levels, "c").select("word", "logp", "entropy", "rank")
    columns = [key, "pos", "word", "logp", "entropy", "rank"]
    if counts.count() <= HEAD_WORDS:
        return long.join(F.broadcast(known), "word").select(*columns)
    head = known.orderBy("rank", "word").limit(HEAD_WORDS)
    met = long.join(F.broadcast(head), "word", "left")
    rare = met.filter(F.col("rank").isNull()).select(key, "pos", "word").join(known, "word")
    return met.filter(F.col("rank").isNotNull()).select(*columns).unionByName(rare.select(*columns))


def _levels(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(count, words, rank, share) for each different count, the highest first: about as many as the root of the number of tokens."""
    rows = counts.groupBy("c").agg(F.count("*").alias("m")).collect()
    rows.sort(key=lambda r: -r.c)
    c, m = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1))
    return c, m, np.cumsum(m) - m + 1, c / max(1, int((c * m).sum()))


def _looked_up(lists: pa.ListArray, table: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(offsets from 0, words, place of each in the table or null) of an array of lists of words."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.string())
    return pa.array(offsets - offsets[0], pa.int32()), flat, pc.index_in(flat, table.column("word").combine_chunks())


def unigram_arrays(docs: DataFrame, words: Column, key: str = "doc_id", head_words: int = TABLE_WORDS) -> DataFrame:
    """(key, logp, entropy, rank): the values of ``unigram_tokens`` as arrays in the order of the words, a row for each document with words.

    Only (word, count) pairs are shuffled.  The commonest words, ``head_words``
    at most, are looked up where the texts lie, in a broadcast table.  If there
    are more, each document's different rare words, not its tokens, meet their
    counts by a join, and come back to the document as one list.
    """
    rows = docs.select(key, words.alias("__w")).filter(F.size("__w") > 0)
    counts = rows.select(F.explode("__w").alias("word")).groupBy("word").agg(F.count("*").alias("c")).persist()
    c, m, rank, share = _levels(counts)
    within = np.flatnonzero(np.cumsum(m) <= head_words)  # words of one count are all in the head, or none is
    least = int(c[within[-1]]) if len(within) else 1 << 62
    head = counts.filter(F.col("c") >= least).toArrow()
    # levels fall, so the place of a count is found among their negatives
    place = np.searchsorted(-c, -head.column("c").to_numpy()) if len(c) else np.zeros(0, dtype=np.int64)
    log = np.log(np.maximum(share, 1e-300))
    values = {"logp": log[place], "entropy": -(share * log)[place], "rank": rank[place]}
    table = pa.table({"word": head.column("word").cast(pa.string()), **{n: pa.array(x) for n, x in values.items()}})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    shared = docs.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
    kind = docs.schema[key].dataType.simpleString()

    def values_of(batches):
        table = pa.ipc.open_stream(shared.value).read_all()
        for batch in batches:
            offsets, flat, found = _looked_up(batch.column(1), table)
            columns = [table.column(n).combine_chunks().take(found) for n in ("logp", "entropy", "rank")]
            if batch.num_columns > 2:  # and each document's own list of rare words, which follow one another in one table
                own = batch.column(2)
                rare = own.values.slice(own.offsets[0].as_py(), own.offsets[-1].as_py() - own.offsets[0].as_py())
                # a word's counts are the same in all lists
                at = pc.index_in(flat, rare.field("word").cast(pa.string()))
                columns = [pc.coalesce(x, rare.field(n).cast(x.type).take(at)) for x, n in zip(columns, ("logp", "entropy", "rank"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.ListArray.from_arrays(offsets, x) for x in columns]], [key, "logp", "entropy", "rank"])

    def rare_of(batches):
        table = pa.ipc.open_stream(shared.value).read_all()
        for batch in batches:
            offsets, flat, found = _looked_up(batch.column(1), table)
            missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
            row = np.searchsorted(offsets.to_numpy(), missing, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), flat.take(pa.array(missing))], [key, "word"])

    schema = f"`{key}` {kind}, logp array<double>, entropy array<double>, rank array<bigint>"
    if len(within) == len(c):
        counts.unpersist()
        return rows.mapInArrow(values_of, schema)
    total = int((c * m).sum())
    levels = docs.sparkSession.createDataFrame([(int(a), int(b)) for a, b in zip(c, rank)], "c bigint, rank bigint")
    p = F.col("c") / F.lit(total)
    known = counts.filter(F.col("c") < least).join(levels, "c").select("word", F.log(p).alias("logp"), (-p * F.log(p)).alias("entropy"), "rank")
    pairs = rows.mapInArrow(rare_of, f"`{key}` {kind}, word string").distinct().join(known, "word")
    lists = pairs.groupBy(key).agg(F.collect_list(F.struct("word", "logp", "entropy", "rank")).alias("__v")).select(F.col(key).alias("__k"), "__v")
    none = F.array().cast("array<struct<word:string,logp:double,entropy:double,rank:bigint>>")
    met = rows.join(lists, F.col(key).eqNullSafe(F.col("__k")), "left").select(key, "__w", F.coalesce("__v", none).alias("__v"))
    return met.mapInArrow(values_of, schema)


def token_arrays(tokens: DataFrame, key: str) -> DataFrame:
    """(key, logp, entropy, rank), what there is of them, as arrays in the order of ``pos``; rows with arrays stay as they are."""
    if "pos" not in tokens.columns:
        return tokens
    there = [c for c in ("logp", "entropy", "rank") if c in tokens.columns]
    held = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", *there))).alias("t"))
    return held.select(key, *[F.col(f"t.{c}").alias(c) for c in there])


def rate(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


# --- of one array --------------------------------------------------------------


def mean(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(array), F.lit(0))


def std(array: Column) -> Column:
    """Population deviation, in two passes."""
    return let(mean(array), lambda m: F.sqrt(F.aggregate(array, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(array)))


def percentile(ordered: Column, share: float) -> Column:
    """Of a sorted array, by linear interpolation."""
    place = share * (F.size(ordered) - 1)
    low = F.floor(place).cast("int")
    at = F.get(ordered, low)
    return at + (place - low) * (F.coalesce(F.get(ordered, low + 1), at) - at)


def percentiles_of(array: Column, shares) -> Column:
    return let(F.sort_array(array), lambda s: F.array(*[percentile(s, q) for q in shares]))


def share_of(array: Column, good) -> Column:
    return F.size(F.filter(array, good)) / F.nullif(F.size(array), F.lit(0))


def rolling_deviation(array: Column, width: int = WINDOW) -> Column:
    """Population deviation of the full-window means; 0 where there are fewer than ``width`` values."""
    windows = F.sequence(F.lit(1), F.greatest(F.size(array) - width + 1, F.lit(1)))
    means = F.transform(windows, lambda i: F.aggregate(F.slice(array, i, width), F.lit(0.0), lambda a, x: a + x) / width)
    return F.when(F.size(array) < width, 0.0).otherwise(let(means, std))


# --- of rows with arrays -------------------------------------------------------


def summary(arrays: DataFrame, key: str) -> DataFrame:
    """Count, moments, extremes and perplexity of logp, and of entropy (mean, std, quartiles)."""
    logp, entropy = F.col("logp"), F.col("entropy")
    out = token_arrays(arrays, key).select(
        key, F.size(logp).cast("double").alias("lp_n_tokens"), mean(logp).alias("lp_mean"), std(logp).alias("lp_std"), F.array_min(logp).alias("lp_min"), F.array_max(logp).alias("lp_max"),
        mean(entropy).alias("lp_ent_mean"), std(entropy).alias("lp_ent_std"), percentiles_of(entropy, (0.25, 0.75)).alias("__q"),
    )
    quarters = [F.get("__q", F.lit(i)).alias(c) for i, c in enumerate(("lp_ent_p25", "lp_ent_p75"))]
    return out.select("*", F.exp(-F.col("lp_mean")).alias("lp_ppl"), (-F.col("lp_mean")).alias("lp_log_ppl"), *quarters).drop("__q")


def percentiles(arrays: DataFrame, key: str) -> DataFrame:
    found = token_arrays(arrays, key).select(key, percentiles_of(F.col("logp"), PERCENTS).alias("p"))
    return found.select(key, *[F.get("p", F.lit(i)).alias(f"lp_p{round(100 * q)}") for i, q in enumerate(PERCENTS)])


def _buckets() -> list[Column]:
    rank, logp = F.col("rank"), F.col("logp")
    within = lambda k: share_of(rank, lambda x: x <= k).alias(f"lp_rank_top{k}")
    return [
        within(10), within(100), within(1000),
        mean(rank).alias("lp_rank_mean"), F.get(percentiles_of(rank, (0.5,)), F.lit(0)).alias("lp_rank_median"),
        share_of(logp, lambda x: x < -10).alias("lp_spike_rate"), share_of(logp, lambda x: x > math.log(0.5)).alias("lp_high_conf_rate"),
    ]


def rank_buckets(arrays: DataFrame, key: str) -> DataFrame:
    return token_arrays(arrays, key).select(key, *_buckets())


def rolling_std(arrays: DataFrame, key: str, width: int = WINDOW) -> DataFrame:
    return token_arrays(arrays, key).select(key, rolling_deviation(F.col("logp"), width).alias("lp_burstiness"))


def full_summary(arrays: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """All 24 features, a row for every id; ids with fewer than two tokens have zeros."""
    whole = token_arrays(arrays, key).select(key, "logp", "entropy", *_buckets(), rolling_deviation(F.col("logp")).alias("lp_burstiness"), percentiles_of(F.col("logp"), PERCENTS).alias("__p"))
    extra = [c for c in whole.columns if c not in (key, "logp", "entropy", "__p")]
    logp, entropy = F.col("logp"), F.col("entropy")
    whole = whole.select(
        key, F.size(logp).cast("double").alias("lp_n_tokens"), mean(logp).alias("lp_mean"), std(logp).alias("lp_std"), F.array_min(logp).alias("lp_min"), F.array_max(logp).alias("lp_max"),
        mean(entropy).alias("lp_ent_mean"), std(entropy).alias("lp_ent_std"), percentiles_of(entropy, (0.25, 0.75)).alias("__q"), *extra,
        *[F.get("__p", F.lit(i)).alias(f"lp_p{round(100 * q)}") for i, q in enumerate(PERCENTS)],
    )
    quarters = [F.get("__q", F.lit(i)).alias(c) for i, c in enumerate(("lp_ent_p25", "lp_ent_p75"))]
    kept = whole.select("*", F.exp(-F.col("lp_mean")).alias("lp_ppl"), (-F.col("lp_mean")).alias("lp_log_ppl"), *quarters).drop("__q").filter("lp_n_tokens >= 2")
    return ids.select(key).distinct().join(kept, key, "left").fillna(0.0)


# --- of rows for each token ----------------------------------------------------


def shifted_loss(tokens: DataFrame, key: str, label: str, ignore: int = -100) -> DataFrame:
    """Rows whose next token is labelled, with ``target``: the label one position on."""
    ahead = F.lead(label).over(Window.partitionBy(key).orderBy("pos"))
    return tokens.withColumn("target", ahead).filter(F.col("target").isNotNull() & (F.col("target") != ignore))


def masked_mean(losses: DataFrame, key: str, loss: str, items: int | None = None) -> DataFrame:
    """Mean loss of each id, or its sum over a given number of items."""
    return losses.groupBy(key).agg((F.avg(loss) if items is None else F.sum(loss) / F.lit(float(items))).alias("loss"))


def top_losses(losses: DataFrame, key: str, loss: str, k: int = 10) -> DataFrame:
    """The ``k`` positions of highest loss in each id; ties go to the earlier."""
    by = Window.partitionBy(key).orderBy(F.desc(loss), "pos")
    return losses.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)
