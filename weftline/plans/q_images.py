"""Queries over images, generated sequences and shuffled streams (S9, D-11, M22, §2.15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import beams, images, shuffling
from ..sources.tables import load
from .catalog import query

# The embeddings, of 64 components, serve as images of 8 by 8.
MEANS, STDS = [0.4914, 0.4822, 0.4465], [0.2470, 0.2435, 0.2616]


@query("""WITH g AS (SELECT w, i, x, greatest(0, 1 - abs((x + 0.5::DOUBLE - (i + 0.5::DOUBLE) * 8 / w) / greatest(8 / w::DOUBLE, 1))) AS t
  FROM (SELECT unnest([5, 16]) AS w) s, range(16) a(i), range(8) b(x) WHERE i < w
  AND x >= floor((i + 0.5::DOUBLE) * 8 / w - greatest(8 / w::DOUBLE, 1) + 0.5) AND x < floor((i + 0.5::DOUBLE) * 8 / w + greatest(8 / w::DOUBLE, 1) + 0.5)),
h AS (SELECT w, i, x, t / sum(t) OVER (PARTITION BY w, i) AS t FROM g),
e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS p, unnest(range(64)) AS k FROM embeddings),
a AS (SELECT vec_id, w, k // 8 AS y, i AS j, sum(p * t) AS p FROM e JOIN h ON h.x = k % 8 GROUP BY ALL),
b AS (SELECT vec_id, a.w, i, j, sum(p * t) AS p FROM a JOIN h ON h.w = a.w AND h.x = y GROUP BY ALL)
SELECT vec_id, list(round(p, 5) ORDER BY i, j) FILTER (w = 5) AS small, list(round(p, 5) ORDER BY i, j) FILTER (w = 16) AS large FROM b GROUP BY vec_id""")
def bilinear_resize(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").select("vec_id", v.doubles(F.col("embedding")).alias("f"))
    out = images.resized(images.resized(e, "f", "small", 8, 8, 5, 5), "f", "large", 8, 8, 16, 16)
    return out.select("vec_id", *[F.transform(c, lambda x: v.rounded(x, 5)).alias(c) for c in ("small", "large")])


@query(f"""WITH e AS (SELECT vec_id, vec_id % 2 AS part, unnest(range(64)) AS k, abs(unnest(embedding)::DOUBLE) AS m FROM embeddings),
a AS (SELECT vec_id, part, k, m / (1 + m) AS m FROM e),
p AS (SELECT vec_id, part, k, c, CASE part WHEN 0 THEN 255 ELSE 1 END * CASE c WHEN 0 THEN m WHEN 1 THEN m * m ELSE 1 - m END AS x FROM a, range(3) r(c)),
t AS (SELECT part, CASE WHEN max(x) > 2 THEN 255.0::DOUBLE ELSE 1 END AS scale FROM p GROUP BY part)
SELECT vec_id, list(round((x / scale - {MEANS}[c + 1]) / {STDS}[c + 1], 5) ORDER BY c, k) AS x FROM p JOIN t USING (part) GROUP BY vec_id""".replace("[0.4914, 0.4822, 0.4465]", "[0.4914::DOUBLE, 0.4822, 0.4465]").replace("[0.247, 0.2435, 0.2616]", "[0.247::DOUBLE, 0.2435, 0.2616]"))
def image_normalise(spark, sf_dir):
    """Two sets of images of three channels, one in levels up to 255, the other in shares; the data say which."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 2).alias("part"), v.doubles(F.col("embedding")).alias("f"))
    share = lambda x: F.abs(x) / (1 + F.abs(x))
    pixels = F.flatten(F.transform("f", lambda x: F.array(share(x), share(x) * share(x), 1 - share(x))))
    levels = F.when(F.col("part") == 0, F.lit(255.0)).otherwise(F.lit(1.0))
    out = images.normalised(e.select("vec_id", "part", F.transform(pixels, lambda x: x * levels).alias("i")), ["part"], "i", (8, 8, 3), MEANS, STDS)
    return out.select("vec_id", F.transform("x", lambda x: v.rounded(x, 5)).alias("x"))


BEAMS = """RECURSIVE c AS (SELECT vec_id // 32 AS g, vec_id % 32 // 4 AS s, vec_id % 4 AS b, (vec_id * 7 + label) % 4 AS p,
  list_position(embedding, list_max(embedding)) - 1 AS t, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings),
n AS (SELECT g, max(s) + 1 AS n FROM c GROUP BY g), e AS (SELECT g, b.range AS beam, greatest(1, n - (g + b.range) % 3) AS len FROM n, range(4) b),
r AS (SELECT e.g, e.beam, c.s, c.p, c.t FROM e JOIN c ON c.g = e.g AND c.s = len - 1 AND c.b = e.beam
  UNION ALL SELECT r.g, r.beam, c.s, c.p, c.t FROM r JOIN c ON c.g = r.g AND c.s = r.s - 1 AND c.b = r.p),
m AS (SELECT g, max(len) AS m FROM e GROUP BY g), f AS (SELECT g, beam, unnest(range(m)) AS s FROM e JOIN m USING (g)),
x AS (SELECT f.g AS "group", f.beam, f.s AS step, r.p AS parent, r.t AS token,
  CASE WHEN r.t IS NULL THEN 0 ELSE l[r.t + 1] - list_max(l) - ln(list_sum(list_transform(l, lambda z: exp(z - list_max(l))))) END AS score
  FROM f LEFT JOIN r USING (g, beam, s) LEFT JOIN c ON c.g = f.g AND c.s = f.s AND c.b = r.p)"""


def _transitions(spark, sf_dir):
    """Embeddings as scores: 8 steps of 4 beams a group; hypotheses end up to two steps early."""
    e = load(spark, sf_dir, "embeddings").withColumn("f", v.doubles(F.col("embedding")))
    e = e.select(
        F.floor(F.col("vec_id") / 32).alias("group"), F.floor(F.col("vec_id") % 32 / 4).cast("int").alias("step"), (F.col("vec_id") % 4).cast("int").alias("beam"),
        ((F.col("vec_id") * 7 + F.col("label")) % 4).cast("int").alias("parent"), v.argmax(F.col("f")).cast("int").alias("token"), "f",
    )
    n = e.groupBy("group").agg((F.max("step") + 1).alias("n")).select("group", "n", F.explode(F.array(*map(F.lit, range(4)))).alias("beam"))
    ends = n.select("group", "beam", F.greatest(F.lit(1), F.col("n") - (F.col("group") + F.col("beam")) % 3).cast("int").alias("length"))
    return beams.transition_scores(e, ends, e.select("group", "step", F.col("beam").alias("row"), F.col("f").alias("scores")))


@query(f'WITH {BEAMS} SELECT "group", beam, step, parent, token, round(score, 6) AS score FROM x')
def transition_scores(spark, sf_dir):
    return _transitions(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(f'WITH {BEAMS} SELECT "group", beam, count(token) AS n_tokens, round(sum(score) / count(token) ** 0.8::DOUBLE, 6) AS score FROM x GROUP BY ALL')
def sequence_scores(spark, sf_dir):
    return beams.sequence_scores(_transitions(spark, sf_dir), length_penalty=0.8).withColumn("score", F.round("score", 6))


@query()
def buffered_shuffle(spark, sf_dir):
    """Documents of each source, in 16 shards, in the order that a shuffle buffer of 1,000 gives each."""
    d = shuffling.sharded(load(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 16)
    return shuffling.buffered_shuffle(d, ["source", "shard"], ["doc_id"])
