"""Queries over per-token values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import tokens as tk
from ..sources.tables import load, spread
from .catalog import query

TOK = """
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)),
c AS (SELECT word, count(*) AS c FROM x GROUP BY 1),
v AS (SELECT word, rank() OVER (ORDER BY c DESC) AS rank, ln(c::DOUBLE / (SELECT sum(c)::DOUBLE FROM c)) AS logp, c::DOUBLE / (SELECT sum(c)::DOUBLE FROM c) AS p FROM c),
t AS (SELECT doc_id, pos, logp, -p * logp AS entropy, rank FROM x JOIN v USING (word))"""


def _tokens(spark, sf_dir):
    return tk.unigram_tokens(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), tx.words(F.col("text")))


def _arrays(spark, sf_dir):
    return tk.unigram_arrays(spread(load(spark, sf_dir, "documents").select("doc_id", "text")), tx.words(F.col("text")))


def _rounded(df, key="doc_id"):
    return df.select(key, *[F.round(c, 6).alias(c) for c in df.columns if c != key])


SUMMARY = """avg(logp) AS lp_mean, stddev_pop(logp) AS lp_std, min(logp) AS lp_min, max(logp) AS lp_max, exp(-avg(logp)) AS lp_ppl, -avg(logp) AS lp_log_ppl,
  avg(entropy) AS lp_ent_mean, stddev_pop(entropy) AS lp_ent_std, quantile_cont(entropy, 0.25) AS lp_ent_p25, quantile_cont(entropy, 0.75) AS lp_ent_p75"""
SUMMARY_COLS = ["lp_mean", "lp_std", "lp_min", "lp_max", "lp_log_ppl", "lp_ent_mean", "lp_ent_std", "lp_ent_p25", "lp_ent_p75"]


@query(f"""WITH {TOK}, s AS (SELECT doc_id, count(*)::DOUBLE AS lp_n_tokens, {SUMMARY} FROM t GROUP BY 1)
SELECT doc_id, lp_n_tokens, {', '.join(f'round({c}, 6) AS {c}' for c in SUMMARY_COLS)}, round(lp_ppl, 3) AS lp_ppl FROM s""")
def token_summary(spark, sf_dir):
    s = tk.summary(_arrays(spark, sf_dir), "doc_id")
    return s.select("doc_id", "lp_n_tokens", *[F.round(c, 6).alias(c) for c in SUMMARY_COLS], F.round("lp_ppl", 3).alias("lp_ppl"))


@query(f"""WITH {TOK} SELECT doc_id, {', '.join(f'round(quantile_cont(logp, {q}), 6) AS lp_p{round(100 * q)}' for q in tk.PERCENTS)} FROM t GROUP BY 1""")
def token_percentiles(spark, sf_dir):
    return _rounded(tk.percentiles(_arrays(spark, sf_dir), "doc_id"))


@query(f"""WITH {TOK}, r AS (SELECT doc_id, avg(logp) OVER (PARTITION BY doc_id ORDER BY pos ROWS 15 PRECEDING) AS m, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM t)
SELECT doc_id, round(coalesce(stddev_pop(CASE WHEN n >= 16 THEN m END), 0.0::DOUBLE), 6) AS lp_burstiness FROM r GROUP BY 1""")
def token_burstiness(spark, sf_dir):
    return _rounded(tk.rolling_std(_arrays(spark, sf_dir), "doc_id"))


BUCKETS = """avg((rank <= 10)::INT::DOUBLE) AS lp_rank_top10, avg((rank <= 100)::INT::DOUBLE) AS lp_rank_top100, avg((rank <= 1000)::INT::DOUBLE) AS lp_rank_top1000,
  avg(rank) AS lp_rank_mean, median(rank) AS lp_rank_median, avg((logp < -10)::INT::DOUBLE) AS lp_spike_rate, avg((logp > ln(0.5::DOUBLE))::INT::DOUBLE) AS lp_high_conf_rate"""
BUCKET_COLS = ["lp_rank_top10", "lp_rank_top100", "lp_rank_top1000", "lp_rank_mean", "lp_rank_median", "lp_spike_rate", "lp_high_conf_rate"]


@query(f"WITH {TOK}, b AS (SELECT doc_id, {BUCKETS} FROM t GROUP BY 1) SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in BUCKET_COLS)} FROM b")
def token_rank_buckets(spark, sf_dir):
    return _rounded(tk.rank_buckets(_arrays(spark, sf_dir), "doc_id"))


LOSS = f"""{TOK}, l AS (SELECT *, CASE WHEN rank % 5 = 0 THEN -100 ELSE rank END AS label FROM t),
s AS (SELECT *, lead(label) OVER (PARTITION BY doc_id ORDER BY pos) AS target FROM l),
m AS (SELECT doc_id, pos, target, -logp AS loss FROM s WHERE target IS NOT NULL AND target <> -100)"""


def _losses(spark, sf_dir):
    t = _tokens(spark, sf_dir).withColumn("label", F.when(F.col("rank") % 5 == 0, -100).otherwise(F.col("rank"))).withColumn("loss", -F.col("logp"))
    return tk.shifted_loss(t, "doc_id", "label")


@query(f"""WITH {LOSS}, r AS (SELECT doc_id, pos, round(loss, 6) AS loss, target FROM m), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loss DESC, pos) AS place FROM r)
SELECT doc_id, CAST(pos AS INT) AS pos, loss, CAST(place AS INT) AS place FROM k WHERE place <= 10""")
def top_loss_positions(spark, sf_dir):
    losses = _losses(spark, sf_dir).withColumn("loss", F.round("loss", 6))
    return tk.top_losses(losses, "doc_id", "loss").select("doc_id", "pos", "loss", "place")


@query(f"WITH {LOSS} SELECT doc_id, round(avg(loss), 6) AS loss, round(sum(loss) / 100.0::DOUBLE, 6) AS loss_by_items FROM m GROUP BY 1")
def masked_token_loss(spark, sf_dir):
    m = _losses(spark, sf_dir)
    both = tk.masked_mean(m, "doc_id", "loss").join(tk.masked_mean(m, "doc_id", "loss", 100).withColumnRenamed("loss", "loss_by_items"), "doc_id")
    return _rounded(both)
