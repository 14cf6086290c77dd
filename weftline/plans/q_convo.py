"""Queries over conversations and batches (F5-F11, T25-T27, D-1 to D-8, W18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convo as cv
from ..sources.tables import load
from .catalog import query

PAIRS = """t AS (SELECT * FROM conversations WHERE role IN ('human', 'user', 'gpt', 'assistant', 'model')),
l AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS r2, lead(text) OVER w AS output FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pair, text AS instruction, output FROM l WHERE role IN ('human', 'user') AND r2 IN ('gpt', 'assistant', 'model'))"""


def _pairs(spark, sf_dir):
    return cv.turn_pairs(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(f"WITH {PAIRS} SELECT * FROM p")
def conv_turn_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT conv_id, pair, CASE WHEN pair = 0 THEN '<|system|>' || chr(10) || 'You are a helpful assistant.' || chr(10) ELSE '' END || '<|user|>' || chr(10) || instruction || chr(10) || '<|assistant|>' || chr(10) AS prompt, output FROM p")
def conv_chat_template(spark, sf_dir):
    return cv.chat_samples(_pairs(spark, sf_dir)).select("conv_id", "pair", "prompt", "output")


@query("""SELECT conv_id, count(*) AS n_turns, arg_min(text, turn) AS first_text, arg_max(text, turn) AS last_text,
 arg_min(text, turn) FILTER (role IN ('gpt', 'assistant', 'model')) AS first_reply FROM conversations GROUP BY 1""")
def conv_first_last(spark, sf_dir):
    return cv.ends(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")


@query(f"WITH {PAIRS} SELECT conv_id, list(instruction ORDER BY pair) AS asked, list(output ORDER BY pair) AS answered FROM p GROUP BY 1")
def conv_packed(spark, sf_dir):
    turns = F.col("conversation")
    return cv.packed(_pairs(spark, sf_dir), "conv_id").select("conv_id", turns["instruction"].alias("asked"), turns["output"].alias("answered"))


@query(f"WITH {PAIRS} SELECT conv_id, pair AS turn, instruction, output FROM p")
def conv_unpacked(spark, sf_dir):
    return cv.unpacked(cv.packed(_pairs(spark, sf_dir), "conv_id"), "conv_id")


@query("""WITH t AS (SELECT *, role IN ('human', 'user') AS u FROM conversations WHERE role IN ('human', 'user', 'gpt', 'assistant', 'model')),
l AS (SELECT conv_id, u, lag(u) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t) SELECT conv_id, count(CASE WHEN u = b THEN 1 END) AS n_violations FROM l GROUP BY 1""")
def conv_role_check(spark, sf_dir):
    return cv.role_violations(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@query("""SELECT conv_id, turn, 'a' AS shape, CASE WHEN role = 'user' THEN text ELSE '' END AS instruction, CASE WHEN role = 'assistant' THEN text ELSE '' END AS output FROM conversations WHERE role IN ('user', 'assistant')
UNION ALL SELECT conv_id, turn, 'b', text, role FROM conversations UNION ALL SELECT conv_id, turn, 'c', text, '' FROM conversations WHERE left(text, 1) NOT IN ('[', '{')""")
def conv_parse_shapes(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    chat = F.to_json(F.array(F.struct(F.col("role").alias("from"), F.col("text").alias("value"))))
    flat = F.to_json(F.struct(F.col("text").alias("question"), F.col("role").alias("answer")))
    shapes = [("a", chat, c.filter("role in ('user', 'assistant')")), ("b", flat, c), ("c", F.col("text"), c.filter(~F.substring("text", 1, 1).isin("[", "{")))]
    one = lambda name, raw, d: d.select("conv_id", "turn", F.lit(name).alias("shape"), F.explode(cv.parse_turns(raw)).alias("t")).select("conv_id", "turn", "shape", "t.*")
    return one(*shapes[0]).unionByName(one(*shapes[1])).unionByName(one(*shapes[2]))


PAD = """x AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INT)) AS ids FROM conversations),
m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) - len(ids) AS n FROM x)"""


@query(f"""WITH {PAD} SELECT conv_id, turn, list_concat(list_resize([]::INT[], n, 0), ids) AS padded, list_concat(list_resize([]::INT[], n, 0), list_resize([]::INT[], len(ids), 1)) AS mask,
 list_concat(list_resize([]::INT[], n, 0), list_transform(ids, lambda x, i: CAST(i - 1 AS INT))) AS position FROM m""")
def conv_left_pad(spark, sf_dir):
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids"))
    return cv.padded(c, "ids", "conv_id").drop("ids")


@query(f"""WITH {PAIRS} SELECT conv_id, pair, list_concat(list_transform(string_split(instruction, ' '), lambda w: CAST(length(w) AS INT)), list_transform(string_split(output, ' '), lambda w: CAST(length(w) AS INT))) AS input_ids,
 list_concat(list_resize([]::INT[], len(string_split(instruction, ' ')), -100), list_transform(string_split(output, ' '), lambda w: CAST(length(w) AS INT))) AS labels FROM p""")
def conv_label_mask(spark, sf_dir):
    size = lambda c: F.transform(F.split(c, " "), lambda w: F.length(w))
    ids, labels = cv.labels_for(size("instruction"), size("output"))
    return _pairs(spark, sf_dir).select("conv_id", "pair", ids.alias("input_ids"), labels.alias("labels"))


@query("""SELECT item_id, list_filter(list_zip(['q1', 'q2', 'q3'], ['Yes', text, ' no ']), lambda z: lower(trim(z[2])) NOT IN ('yes', 'no'))[1][2] AS answer,
 CASE item_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM benchmark""")
def qa_filters(spark, sf_dir):
    q = F.array(*map(F.lit, ("q1", "q2", "q3")))
    a = F.array(F.lit("Yes"), F.col("text"), F.lit(" no "))
    b = load(spark, sf_dir, "benchmark").select("item_id", q.alias("q"), a.alias("a"))
    kept = F.get(cv.drop_yes_no(F.col("q"), F.col("a")), F.lit(0))
    return b.select("item_id", kept["a"].alias("answer"), cv.split_name((F.col("item_id") % 3 + 1).cast("int")).alias("split"))


@query()
def length_grouped_batches(spark, sf_dir):
    return cv.length_grouped(load(spark, sf_dir, "documents"), "doc_id", "n_chars", 8, 4)


@query("WITH m AS (SELECT *, min(value) OVER (PARTITION BY event_type) AS g FROM events) SELECT event_id, round(least(1.0::DOUBLE, g / (value + 1e-6::DOUBLE)), 6) AS scale FROM m")
def clip_scale(spark, sf_dir):
    return cv.clip_scale(load(spark, sf_dir, "events"), "value", "event_type").select("event_id", F.round("scale", 6).alias("scale"))


@query()
def token_segments(spark, sf_dir):
    """Texts as word lengths, in which a length of 9 opens and 10 closes an image, 11 and 12 a sound."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    parts = cv.segments(F.col("ids"), F.col("ids"), {"image": 9, "audio": 11}, {"image": 10, "audio": 12})
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", ids.alias("ids")).withColumn("parts", parts)
    return c.select("conv_id", "turn", "parts", cv.modality_mask(F.col("parts"), "image").alias("image_mask"))


SHARDED = "SELECT doc_id, source, row_number() OVER (ORDER BY md5('shard:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents"


@query(f"SELECT doc_id, source, 'strided' AS how FROM ({SHARDED}) WHERE i % 7 = 3 UNION ALL SELECT doc_id, source, 'run' FROM ({SHARDED}) WHERE i >= n * 3 // 7 AND i < n * 4 // 7")
def rank_shards(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "source")
    one = lambda how, run: cv.shard_rows(d, "doc_id", 7, 3, run).withColumn("how", F.lit(how))
    return one("strided", False).unionByName(one("run", True))


@query("WITH f AS (SELECT user_id, min(event_id) AS e FROM events GROUP BY 1 ORDER BY e, user_id LIMIT 20) SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM f)")
def first_users(spark, sf_dir):
    return cv.first_users(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", 20)
