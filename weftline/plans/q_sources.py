"""Queries over scans, adapters and what is left (S5, S9, D-2, P22, L1-L7 in full, ML14, ML16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii as p
from ..functions import text as tx
from ..functions import vectors as v
from ..operators import pii as op
from ..operators import tokens as tk
from ..sources import annotations as an
from ..sources.tables import load, normalise_channels, read_parquet_with_origin, spread
from .catalog import query
from .q_pii import PHONE_SQL, SCORED_SQL
from .q_tokens import BUCKET_COLS, BUCKETS, SUMMARY, TOK


@query("SELECT 'nation.parquet' AS _source_file, count(*) AS n FROM nation")
def parquet_origin(spark, sf_dir):
    return read_parquet_with_origin(spark, f"{sf_dir}/nation.parquet").groupBy("_source_file").agg(F.count("*").alias("n"))


@query("SELECT vec_id, list_transform(embedding, lambda x, i: round((x::DOUBLE * 2 - [0.1::DOUBLE, 0.2, 0.3][(i - 1) % 3 + 1]) / [0.5::DOUBLE, 0.25, 2.0][(i - 1) % 3 + 1], 5)) AS x FROM embeddings")
def channel_normalise(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    out = normalise_channels(v.doubles(F.col("embedding")), [0.1, 0.2, 0.3], [0.5, 0.25, 2.0], 2.0)
    return e.select("vec_id", F.transform(out, lambda x: v.rounded(x, 5)).alias("x"))


@query("""SELECT item_id AS key, 'q' || chr(10) || 'A. ' || text || chr(10) || 'B. no' AS instruction, 'The answer is ' || CASE item_id % 2 WHEN 0 THEN 'A' ELSE 'B' END || '. as said' AS output
FROM benchmark WHERE item_id % 3 <> 2""")
def adapter_multiple_choice(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").withColumn("q", F.lit("q")).withColumn("o", F.array(F.col("text"), F.lit("no"))).withColumn("r", F.lit("as said"))
    label = F.when(F.col("item_id") % 3 == 2, "Z").when(F.col("item_id") % 2 == 0, "a)").otherwise("b)")
    out = an.multiple_choice(b.withColumn("l", label), "item_id", "q", "o", "l", "r", "item_id")
    return out.select("key", F.explode("conversation").alias("t")).select("key", "t.*")


@query("SELECT item_id AS key, 'q2' AS instruction, text AS output FROM benchmark WHERE trim(text) <> '' AND lower(trim(text)) NOT IN ('yes', 'no')")
def adapter_question_answers(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").withColumn("q", F.array(F.lit("q1"), F.lit("q2"), F.lit("q3"))).withColumn("a", F.array(F.lit("Yes"), F.col("text"), F.lit(" NO ")))
    return an.question_answers(b, "item_id", "item_id", "q", "a").select("key", F.explode("conversation").alias("t")).select("key", "t.*")


FULL = [f"lp_p{round(100 * q)}" for q in tk.PERCENTS]


@query(f"""WITH {TOK}, s AS (SELECT doc_id, count(*) AS n, {SUMMARY}, {BUCKETS}, {', '.join(f'quantile_cont(logp, {q}) AS lp_p{round(100 * q)}' for q in tk.PERCENTS)} FROM t GROUP BY 1)
SELECT doc_id, {', '.join(f'round(CASE WHEN n >= 2 THEN {c} ELSE 0 END, 6) AS {c}' for c in ['lp_mean', 'lp_std', *FULL, *BUCKET_COLS])} FROM documents JOIN s USING (doc_id)
UNION ALL SELECT doc_id, {', '.join('0.0' for _ in ['lp_mean', 'lp_std', *FULL, *BUCKET_COLS])} FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def token_features(spark, sf_dir):
    d = spread(load(spark, sf_dir, "documents").select("doc_id", "text"))
    out = tk.full_summary(tk.unigram_arrays(d, tx.words(F.col("text"))), d, "doc_id")
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ["lp_mean", "lp_std", *FULL, *BUCKET_COLS]])


@query("SELECT doc_id, round(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 / 100.0::DOUBLE, 4) AS score FROM documents")
def hash_baseline(spark, sf_dir):
    from ..operators.evaluate import hash_bucket

    return load(spark, sf_dir, "documents").select("doc_id", F.round(hash_bucket(F.col("doc_id")) / 100.0, 4).alias("score"))


@query("WITH c AS (SELECT count(l.doc_id) / count(*)::DOUBLE AS r FROM documents LEFT JOIN labels l USING (doc_id)) SELECT round(r * 0.66::DOUBLE + (1 - r) * 0.45::DOUBLE, 6) AS expected FROM c")
def expected_score(spark, sf_dir):
    """The score to expect where some ids have a model's value and the rest a default."""
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("x")), "doc_id", "left")
    r = F.count("x") / F.count("*")
    return d.agg(F.round(r * 0.66 + (1 - r) * 0.45, 6).alias("expected"))


STRICT_SQL = PHONE_SQL.replace("FROM documents", r"FROM (SELECT doc_id, regexp_replace(text, '\b\d{1,3}(?:\.\d{1,3}){3}\b', ' ', 'g') AS text FROM documents)")


@query(STRICT_SQL)
def pii_strict_phone(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.explode(p.strict_phones(F.col("text"))).alias("cand"))


# the text behind a candidate is its owner's name and the candidate, so the two stand eleven characters apart
NAMED_SQL = SCORED_SQL.replace("1.0::DOUBLE + 0.1::DOUBLE - CASE WHEN doc_id % 3 = 0 THEN 0.6::DOUBLE ELSE 0 END", "1.0::DOUBLE + 0.5::DOUBLE + 0.6::DOUBLE").replace(
    "WHEN 'EMAIL' THEN CASE WHEN lower", "WHEN 'EMAIL' THEN CASE WHEN lower(split_part(cand, '@', 1)) IN ('jane.doe', 'janedoe', 'jane_doe', 'doe', 'jane', 'jdoe', 'j.doe') THEN 0.8::DOUBLE ELSE 0.0 END + CASE WHEN lower"
)


@query(f"WITH {NAMED_SQL} SELECT doc_id, pii_type, cand, round(score, 6) AS score FROM s")
def pii_named_scores(spark, sf_dir):
    """Candidate scores with a name to look for."""
    c = op.candidates(load(spark, sf_dir, "documents"), "doc_id", "text").withColumn("raw", F.concat(F.lit("jane doe: "), "cand")).withColumn("name", F.lit("Jane Doe"))
    return op.score_candidates(c, op.profile(c, value="cand"), name="name").select("doc_id", "pii_type", "cand", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id, kind, trim(regexp_extract(text, CASE kind WHEN 'EMAIL' THEN '{p.EMAIL}' WHEN 'CREDIT' THEN '{p.CARD}' ELSE '{p.PHONE}' END)) AS value FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'CREDIT' ELSE 'PHONE' END AS kind FROM documents) WHERE value <> ''")
def pii_first_value(spark, sf_dir):
    m = F.col("doc_id") % 3
    d = load(spark, sf_dir, "documents").withColumn("kind", F.when(m == 0, "EMAIL").when(m == 1, "CREDIT").otherwise("PHONE"))
    return d.select("doc_id", "kind", p.first_value(F.col("text"), F.col("kind")).alias("value")).filter("value is not null")


TURNS_SQL = "SELECT conv_id, list({'from': CASE role WHEN 'user' THEN 'human' ELSE 'gpt' END, 'value': text} ORDER BY turn) AS c FROM conversations WHERE role <> 'system' GROUP BY 1"


@query(f"""WITH c AS ({TURNS_SQL}), g AS (SELECT * FROM c WHERE len(c) >= 2 AND len(list_filter(c, lambda t, i: t['from'] <> CASE i % 2 WHEN 1 THEN 'human' ELSE 'gpt' END)) = 0), x AS (SELECT conv_id, c, unnest(range(len(c) // 2)) AS k FROM g)
SELECT conv_id AS key, 'm' || conv_id AS media, k AS pair, c[2 * k + 1]['value'] AS instruction, c[2 * k + 2]['value'] AS output FROM x""")
def adapter_role_conversations(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").filter("role <> 'system'")
    turn = F.struct("turn", F.when(F.col("role") == "user", "human").otherwise("gpt").alias("from"), F.col("text").alias("value"))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("conversations")).withColumn("m", F.concat(F.lit("m"), "conv_id"))
    out = an.role_conversations(turns, "conv_id", "m")
    return out.select("key", "media", F.posexplode("conversation").alias("pair", "t")).select("key", "media", F.col("pair").cast("long").alias("pair"), "t.*")


@query("SELECT item_id AS key, item_id AS media, 'Describe the image.' AS instruction, text AS output FROM benchmark WHERE trim(text) <> '' AND item_id % 4 <> 1")
def adapter_captions(spark, sf_dir):
    """Of the references two are blank, so that one is left to choose; items without any go."""
    refs = F.array(F.lit(" "), F.when(F.col("item_id") % 4 != 1, F.col("text")).otherwise(""), F.lit(""))
    out = an.captions(load(spark, sf_dir, "benchmark").withColumn("refs", refs), "item_id", "refs")
    return out.select("key", "media", F.explode("conversation").alias("t")).select("key", "media", "t.*")


@query("SELECT p.item_id AS key, 'Read the text in the image.' AS instruction, p.text AS output, 'f' || p.item_id AS file FROM benchmark p WHERE trim(text) <> '' AND item_id % 3 = 0")
def adapter_transcriptions(spark, sf_dir):
    """Only those whose media are there."""
    b = load(spark, sf_dir, "benchmark")
    media = b.filter("item_id % 3 = 0").select(F.col("item_id").alias("id"), F.concat(F.lit("f"), "item_id").alias("file"))
    out = an.with_media(an.transcriptions(b, "item_id", "text"), media, "id")
    return out.select("key", "file", F.explode("conversation").alias("t")).select("key", "file", "t.*")


@query("SELECT count(*) AS n_missing FROM benchmark WHERE item_id % 3 <> 0")
def adapter_without_media(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark")
    media = b.filter("item_id % 3 = 0").select(F.col("item_id").alias("id"))
    return an.without_media(an.transcriptions(b, "item_id", "text"), media, "id")


@query("SELECT conv_id, turn, concat_ws(' ', role, text) AS joined FROM conversations")
def join_strings(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", tx.join_strings(F.col("role"), F.col("text")).alias("joined"))
