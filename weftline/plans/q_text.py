"""Queries over text statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import load, spread
from .catalog import query

W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
SENT = "list_filter(regexp_split_to_array(trim(text), '[.!?]+\\s+'), lambda s: trim(s) <> '')"


@query(f"""
WITH w AS (SELECT doc_id, length(text) AS n, {W} AS w FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS stat_n_chars, CAST(len(w) AS BIGINT) AS stat_n_words,
       CAST(len(list_distinct(w)) AS BIGINT) AS stat_n_unique_words,
       round(CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(w))::DOUBLE / len(w) END, 6) AS stat_ttr
FROM w""")
def stylometry_counts(spark, sf_dir):
    d = spread(load(spark, sf_dir, "documents")).withColumn("w", tx.words(F.col("text")))
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("stat_n_chars"),
        F.size("w").cast("long").alias("stat_n_words"),
        tx.distinct_words(F.col("w")).alias("stat_n_unique_words"),
        F.round(tx.ratio(tx.distinct_words(F.col("w")), F.size("w")), 6).alias("stat_ttr"),
    )


@query(f"""
WITH w AS (SELECT doc_id, list_transform({W}, lambda x: length(x)::DOUBLE) AS l FROM documents)
SELECT doc_id, round(coalesce(list_avg(l), 0.0::DOUBLE), 6) AS stat_avg_word_len,
       round(coalesce(list_stddev_pop(l), 0.0::DOUBLE), 6) AS stat_std_word_len FROM w""")
def stylometry_wordlen(spark, sf_dir):
    d = spread(load(spark, sf_dir, "documents")).withColumn("w", tx.words(F.col("text")))
    return d.select(
        "doc_id", F.round(tx.mean_length(F.col("w")), 6).alias("stat_avg_word_len"), F.round(tx.std_length(F.col("w")), 6).alias("stat_std_word_len")
    )


def _entropy_sql(items: str, name: str) -> str:
    return f"""
WITH x AS (SELECT doc_id, unnest({items}) AS x FROM documents),
c AS (SELECT doc_id, x, count(*)::DOUBLE AS c FROM x GROUP BY ALL),
e AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(e, 0.0::DOUBLE), 6) AS {name} FROM documents LEFT JOIN e USING (doc_id)"""


@query(_entropy_sql("string_split(text, '')", "stat_char_entropy"))
def stylometry_char_entropy(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", F.round(tx.item_entropy(tx.characters(F.col("text"))), 6).alias("stat_char_entropy"))


@query(_entropy_sql(W, "stat_word_entropy"))
def stylometry_word_entropy(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents")).select("doc_id", F.round(tx.item_entropy(tx.words(F.col("text"))), 6).alias("stat_word_entropy"))


@query(f"""
WITH w AS (SELECT doc_id, {W} AS w FROM documents),
b AS (SELECT doc_id, unnest(list_zip(w[1:len(w)-1], w[2:])) AS b FROM w WHERE len(w) > 1),
c AS (SELECT doc_id, b, count(*) AS c FROM b GROUP BY ALL),
r AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::DOUBLE / sum(c)::DOUBLE AS r FROM c GROUP BY doc_id)
SELECT doc_id, round(coalesce(r, 0.0::DOUBLE), 6) AS stat_bigram_repeat_rate FROM documents LEFT JOIN r USING (doc_id)""")
def stylometry_bigram_repeat(spark, sf_dir):
    d = spread(load(spark, sf_dir, "documents")).select("doc_id", tx.words(F.col("text")).alias("w"))
    return d.select("doc_id", F.round(tx.repeat_rate(tx.bigrams(F.col("w"))), 6).alias("stat_bigram_repeat_rate"))


def _rate(pattern: str) -> str:
    return f"round((length(text) - length(regexp_replace(text, '{pattern}', '', 'g')))::DOUBLE / greatest(length(text), 1), 6)"


PUNCT_SQL = "[.,;:!?\\-—''\"()\\[\\]{}]"


@query(f"""SELECT doc_id, {_rate(PUNCT_SQL)} AS stat_punct_rate, {_rate(chr(92) + "n")} AS stat_newline_rate,
       {_rate(chr(92) + "p{Lu}")} AS stat_uppercase_rate, {_rate(chr(92) + "p{Nd}")} AS stat_digit_rate FROM documents""")
def stylometry_char_rates(spark, sf_dir):
    t, n = F.col("text"), F.length("text")
    rate = lambda p, name: F.round(tx.ratio(tx.matches(t, p), n), 6).alias(name)
    return spread(load(spark, sf_dir, "documents")).select(
        "doc_id", rate(tx.PUNCTUATION, "stat_punct_rate"), rate(r"\n", "stat_newline_rate"), rate(r"\p{Lu}", "stat_uppercase_rate"), rate(r"\p{Nd}", "stat_digit_rate")
    )


SENTENCE_SQL = f"""
SELECT doc_id, CAST(len(s) AS BIGINT) AS stat_n_sentences,
       round(CASE WHEN len(s) < 2 THEN 0.0::DOUBLE ELSE list_stddev_pop(l) / (list_avg(l) + 1e-9::DOUBLE) END, 6) AS stat_sent_burstiness
FROM (SELECT doc_id, s, list_transform(s, lambda x: len(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]+'))::DOUBLE) AS l
      FROM (SELECT doc_id, {SENT} AS s FROM documents))"""


@query(SENTENCE_SQL)
def stylometry_sentences(spark, sf_dir):
    t = F.col("text")
    return spread(load(spark, sf_dir, "documents")).select(
        "doc_id", F.size(tx.sentences(t)).cast("long").alias("stat_n_sentences"), F.round(tx.burstiness(t), 6).alias("stat_sent_burstiness")
    )


FULL_SQL = f"""
WITH w AS (SELECT doc_id, text, {W} AS w, length(text) AS n FROM documents),
ch AS (SELECT doc_id, x, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(string_split(text, '')) AS x FROM documents) GROUP BY ALL),
che AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM ch GROUP BY doc_id),
wd AS (SELECT doc_id, x, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY ALL),
wde AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS e FROM wd GROUP BY doc_id),
bg AS (SELECT doc_id, b, count(*) AS c FROM (SELECT doc_id, unnest(list_zip(w[1:len(w)-1], w[2:])) AS b FROM w WHERE len(w) > 1) GROUP BY ALL),
bgr AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::DOUBLE / sum(c)::DOUBLE AS r FROM bg GROUP BY doc_id),
st AS ({SENTENCE_SQL})
SELECT doc_id, quality, CAST(n AS BIGINT) AS stat_n_chars, CAST(len(w) AS BIGINT) AS stat_n_words,
       CAST(len(list_distinct(w)) AS BIGINT) AS stat_n_unique_words,
       round(CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(list_distinct(w))::DOUBLE / len(w) END, 6) AS stat_ttr,
       round(coalesce(list_avg(list_transform(w, lambda x: length(x)::DOUBLE)), 0.0::DOUBLE), 6) AS stat_avg_word_len,
       round(coalesce(list_stddev_pop(list_transform(w, lambda x: length(x)::DOUBLE)), 0.0::DOUBLE), 6) AS stat_std_word_len,
       {_rate(PUNCT_SQL)} AS stat_punct_rate, {_rate(chr(92) + "n")} AS stat_newline_rate,
       {_rate(chr(92) + "p{Lu}")} AS stat_uppercase_rate, {_rate(chr(92) + "p{Nd}")} AS stat_digit_rate,
       stat_n_sentences, stat_sent_burstiness,
       round(coalesce(che.e, 0.0::DOUBLE), 6) AS stat_char_entropy, round(coalesce(wde.e, 0.0::DOUBLE), 6) AS stat_word_entropy,
       round(coalesce(r, 0.0::DOUBLE), 6) AS stat_bigram_repeat_rate
FROM w JOIN labels USING (doc_id) JOIN st USING (doc_id) LEFT JOIN che USING (doc_id) LEFT JOIN wde USING (doc_id) LEFT JOIN bgr USING (doc_id)"""


@query(FULL_SQL)
def stylometry_full(spark, sf_dir):
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = spread(load(spark, sf_dir, "documents")).join(labels.select("doc_id"), "doc_id", "left_semi")
    wide = tx.stylometry(docs)
    rounded = [F.round(c, 6).alias(c) if dict(wide.dtypes)[c] == "double" else F.col(c) for c in wide.columns]
    return wide.select(*rounded).join(labels, "doc_id")


@query("""SELECT doc_id, translate(lower(source || '/' || lang || '-v1.0'), '/-.', '___') AS tag,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE lang END AS shown FROM documents""")
def text_cache_tag(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    name = F.concat("source", F.lit("/"), "lang", F.lit("-v1.0"))
    return d.select("doc_id", tx.cache_tag(name).alias("tag"), tx.stringify(F.when(F.col("doc_id") % 7 != 0, F.col("lang"))).alias("shown"))


@query(r"""
WITH t AS (SELECT conv_id, turn, trim(regexp_replace(trim(replace(replace('<s> Answer: "' || text || '".', '<s>', ''), '```', '')),
    '^(answer|pred|prediction|email|phone|credit|card|number)\s*[:：]\s*', '', 'i')) AS t FROM conversations)
SELECT conv_id, turn, trim(t, ' ' || chr(9) || chr(13) || chr(10) || '"''`*_.,;:!?#[]{}()<>') AS cleaned FROM t""")
def text_clean_edges(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", tx.clean_edges(F.concat(F.lit('<s> Answer: "'), "text", F.lit('".'))).alias("cleaned"))


@query("""SELECT p_partkey, 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || CAST(p_size AS VARCHAR) AS options,
  'The answer is ' || substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1) || '. ' || p_name AS answer
  FROM part WHERE upper(substr('ABCD', CAST(p_partkey % 4 AS INT) + 1, 1)) IN ('A', 'B', 'C', 'D')""")
def mcq_format(spark, sf_dir):
    p = load(spark, sf_dir, "part").withColumn("label", F.substring(F.lit("ABCD"), (F.col("p_partkey") % 4 + 1).cast("int"), F.lit(1)))
    valid = p.filter(F.upper(F.substring("label", 1, 1)).isin("A", "B", "C", "D"))
    return valid.select(
        "p_partkey",
        tx.lettered_options(F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("options"),
        tx.answer_text(F.col("label"), F.col("p_name")).alias("answer"),
    )


@query("""SELECT item_id, '<image_start><image><image_end>' || chr(10) || 'You are given the following text passage: ' || text || chr(10)
  || '<question_start>What is it?<question_end>' AS asked, '<image_start><image><image_end>' AS head,
  [CAST(item_id AS INT), CAST(item_id + 7 AS INT)] AS codes, CAST(item_id AS VARCHAR) AS stem FROM benchmark""")
def text_templates(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark")
    asked = tx.formatted_question(F.lit(" <image>What is it? "), ["image", "text"], F.col("text"))
    marks = F.concat(F.lit("<vqgan_"), "item_id", F.lit("> and <vqgan_"), F.col("item_id") + 7, F.lit(">"))
    path = F.concat(F.lit("images/COCO_train_"), "item_id", F.lit(".jpg"))
    return b.select("item_id", asked.alias("asked"), tx.before_question(asked).alias("head"), tx.marked_integers(marks).alias("codes"), tx.file_stem(path).alias("stem"))
