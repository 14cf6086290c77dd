"""Queries over vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import geometry as g
from ..sources.tables import load
from .catalog import query

BASE = """
e AS (SELECT vec_id, label, CASE WHEN vec_id % 2 = 0 THEN 'mix' ELSE 'pop' END AS side,
        list_transform(embedding, lambda x: x::DOUBLE) AS f,
        list_transform(embedding, lambda x: 10 * x::DOUBLE) AS l FROM embeddings),
m AS (SELECT *, list_max(l) AS t FROM e),
z AS (SELECT *, t + ln(list_sum(list_transform(l, lambda x: exp(x - t)))) AS lse FROM m),
p AS (SELECT *, list_transform(l, lambda x: exp(x - lse)) AS p, list_reverse_sort(l) AS o FROM z),
q AS (SELECT *, list_reverse_sort(p) AS po FROM p)"""


def _base(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("f", v.doubles(F.col("embedding")))
    e = e.withColumn("side", F.when(F.col("vec_id") % 2 == 0, "mix").otherwise("pop"))
    e = e.withColumn("l", F.transform("f", lambda x: x * 10))
    return e.withColumn("p", v.softmax(F.col("l"))).drop("embedding")


@query(f"""WITH {BASE} SELECT vec_id, list_transform(p, lambda x: round(x, 6)) AS probs,
  round(-list_sum(list_transform(p, lambda x: x * ln(x + 1e-12::DOUBLE))), 6) AS entropy, round(po[1] - po[2], 6) AS margin FROM q""")
def vec_softmax_entropy_margin(spark, sf_dir):
    p = F.col("p")
    return _base(spark, sf_dir).select(
        "vec_id", F.transform(p, lambda x: F.round(x, 6)).alias("probs"), F.round(v.entropy(p), 6).alias("entropy"), F.round(v.margin(p), 6).alias("margin")
    )


@query(f"""WITH {BASE} SELECT vec_id, round(lse - l[label + 1], 6) AS loss, round(l[label + 1] - lse, 6) AS log_prob,
  round(p[label + 1], 6) AS true_prob FROM q""")
def vec_cross_entropy(spark, sf_dir):
    l, y = F.col("l"), F.col("label")
    return _base(spark, sf_dir).select(
        "vec_id", F.round(v.cross_entropy(l, y), 6).alias("loss"), F.round(v.at(v.log_softmax(l), y), 6).alias("log_prob"), F.round(v.at(F.col("p"), y), 6).alias("true_prob")
    )


@query(f"WITH {BASE} SELECT vec_id, round(lse, 6) AS energy, round(o[1] - o[2], 6) AS logit_margin FROM q")
def vec_energy(spark, sf_dir):
    return _base(spark, sf_dir).select("vec_id", F.round(v.log_sum_exp(F.col("l")), 6).alias("energy"), F.round(v.margin(F.col("l")), 6).alias("logit_margin"))


@query(f"""WITH {BASE} SELECT vec_id, CAST(list_position(l, t) - 1 AS INT) AS predicted, round(po[1], 6) AS confidence,
  (list_position(l, t) - 1 = label) AS correct, CAST(len(list_filter(l, lambda x: x > l[label + 1])) + 1 AS INT) AS rank FROM q""")
def vec_argmax(spark, sf_dir):
    l = F.col("l")
    return _base(spark, sf_dir).select(
        "vec_id", v.argmax(l).alias("predicted"), F.round(v.confidence(F.col("p")), 6).alias("confidence"), (v.argmax(l) == F.col("label")).alias("correct"),
        v.rank_of(l, F.col("label")).alias("rank"),
    )


@query(f"""WITH {BASE}, n AS (SELECT vec_id, f, lead(f) OVER (ORDER BY vec_id) AS g FROM e)
SELECT vec_id, round(sqrt(list_sum(list_transform(f, lambda x: x * x))), 6) AS norm,
  round(list_inner_product(f, g), 6) AS dot, round(list_cosine_similarity(f, g), 6) AS cosine, round(list_distance(f, g), 6) AS distance
FROM n WHERE g IS NOT NULL""")
def vec_norm_cosine(spark, sf_dir):
    e = _base(spark, sf_dir).select("vec_id", "f")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("f").alias("g")), "vec_id")
    a, b = F.col("f"), F.col("g")
    return pairs.select(
        "vec_id", F.round(v.norm(a), 6).alias("norm"), F.round(v.dot(a, b), 6).alias("dot"), F.round(v.cosine(a, b), 6).alias("cosine"), F.round(v.distance(a, b), 6).alias("distance")
    )


@query(f"""WITH {BASE}, r AS (SELECT vec_id, list_sum(list_transform(p, lambda x, i: (x - CASE WHEN i = label + 1 THEN 1 ELSE 0 END) ** 2)) AS e,
  list_sum(list_transform(f, lambda x: x * x)) AS s FROM q) SELECT vec_id, round(sqrt(e * s + e), 6) AS grad_norm FROM r""")
def vec_grad_norm(spark, sf_dir):
    return _base(spark, sf_dir).select("vec_id", F.round(v.last_layer_gradient_norm(F.col("p"), F.col("label"), F.col("f")), 6).alias("grad_norm"))


@query(f"""WITH {BASE}, x AS (SELECT label, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM e), a AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL)
SELECT label, (SELECT count(*) FROM e WHERE e.label = a.label) AS n, list(round(m, 6) ORDER BY i) AS mean FROM a GROUP BY label""")
def class_centroids(spark, sf_dir):
    m = g.mean_vectors(_base(spark, sf_dir), ["label"], "f")
    return m.select("label", "n", F.transform("mean", lambda x: v.rounded(x, 6)).alias("mean"))


@query(f"""WITH {BASE}, x AS (SELECT side, label, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM e),
a AS (SELECT side, label, i, avg(x) AS m FROM x GROUP BY ALL),
c AS (SELECT side, label, list(m ORDER BY i) AS m FROM a GROUP BY ALL),
w AS (SELECT e.side, e.label, avg(list_sum(list_transform(list_zip(f, m), lambda z: (z[1] - z[2]) ** 2)) / len(f)) AS w FROM e JOIN c USING (side, label) GROUP BY ALL),
i AS (SELECT side, avg(w) AS intra FROM w GROUP BY side),
d AS (SELECT a.side, list_distance(a.m, b.m) AS d FROM c a JOIN c b ON a.side = b.side AND a.label < b.label)
SELECT side, round(any_value(intra), 6) AS intra, round(avg(d), 6) AS inter_mean, round(stddev_pop(d), 6) AS inter_std,
  round(avg(d) / (any_value(intra) + 1e-12::DOUBLE), 4) AS fisher FROM d JOIN i USING (side) GROUP BY side""")
def class_geometry(spark, sf_dir):
    out = g.class_geometry(_base(spark, sf_dir), "side", "label", "f")
    return out.select("side", *[F.round(c, 6).alias(c) for c in ("intra", "inter_mean", "inter_std")], F.round("fisher", 4).alias("fisher"))


CONF = f"""WITH {BASE}, c AS (SELECT side, p[label + 1] AS t, po[1] - po[2] AS m, -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12::DOUBLE))) AS h,
  sqrt(list_sum(list_transform(l, lambda x: x * x))) AS n FROM q),
s AS (SELECT side, avg(t) AS true_prob_mean, stddev_pop(t) AS true_prob_std, avg(m) AS margin_mean, stddev_pop(m) AS margin_std,
  avg(h) AS entropy_mean, stddev_pop(h) AS entropy_std, avg(n) AS logit_norm_mean, stddev_pop(n) AS logit_norm_std FROM c GROUP BY side)"""
CONF_COLS = [f"{n}_{s}" for n in ("true_prob", "margin", "entropy", "logit_norm") for s in ("mean", "std")]


@query(f"{CONF} SELECT side, {', '.join(f'round({c}, 6) AS {c}' for c in CONF_COLS)} FROM s")
def confidence_features(spark, sf_dir):
    out = g.confidence_features(_base(spark, sf_dir), ["side"], "p", "l", "label")
    return out.select("side", *[F.round(c, 6).alias(c) for c in CONF_COLS])


@query(
    f"{CONF} SELECT "
    + ", ".join(f"round(a.{c}, 6) AS mix_{c}, round(b.{c}, 6) AS pop_{c}, round(a.{c} - b.{c}, 6) AS gap_{c}" for c in CONF_COLS)
    + " FROM s a, s b WHERE a.side = 'mix' AND b.side = 'pop'"
)
def gap_features(spark, sf_dir):
    out = g.gaps(g.confidence_features(_base(spark, sf_dir), ["side"], "p", "l", "label"), [], "side", CONF_COLS)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"""WITH {BASE}, x AS (SELECT label, side, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM e), a AS (SELECT label, side, i, avg(x) AS m FROM x GROUP BY ALL),
c AS (SELECT label, side, list(m ORDER BY i) AS m FROM a GROUP BY ALL)
SELECT a.label, round(list_distance(a.m, b.m), 6) AS feat_l2, round(list_cosine_similarity(a.m, b.m), 6) AS feat_cos
FROM c a JOIN c b USING (label) WHERE a.side = 'mix' AND b.side = 'pop'""")
def feature_distance(spark, sf_dir):
    out = g.feature_distance(_base(spark, sf_dir), ["label"], "side", "f")
    return out.filter("feat_l2 is not null").select("label", F.round("feat_l2", 6).alias("feat_l2"), F.round("feat_cos", 6).alias("feat_cos"))


@query()
def spectral_features(spark, sf_dir):
    return g.spectral_features(_base(spark, sf_dir), "side", "f")


@query("""WITH p AS (SELECT hour(ts) AS b, count(*) AS a FROM events WHERE event_type = 'click' GROUP BY 1), q AS (SELECT hour(ts) AS b, count(*) AS c FROM events WHERE event_type <> 'click' GROUP BY 1),
j AS (SELECT coalesce(a, 0) AS a, coalesce(c, 0) AS c FROM p FULL JOIN q USING (b)), s AS (SELECT a / (SELECT sum(a) FROM j) + 1e-12::DOUBLE AS p, c / (SELECT sum(c) FROM j) + 1e-12::DOUBLE AS q FROM j)
SELECT round(0.5::DOUBLE * sum(p * ln(p / q) + q * ln(q / p)), 6) AS kl FROM s""")
def symmetric_kl(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.hour("ts").alias("b"), "event_type")
    count = lambda d: d.groupBy("b").agg(F.count("*").alias("n"))
    return g.symmetric_kl(count(e.filter("event_type = 'click'")), count(e.filter("event_type <> 'click'")), "b").select(F.round("kl", 6).alias("kl"))


@query("""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), f AS (SELECT r.range AS label, coalesce(n, 0) AS n FROM range(12) r LEFT JOIN c ON c.label = r.range)
SELECT label, n, round(n / (SELECT sum(n) FROM f), 6) AS share FROM f""")
def label_histogram(spark, sf_dir):
    out = g.label_histogram(load(spark, sf_dir, "embeddings"), "label", 12)
    return out.select("label", "n", F.round("share", 6).alias("share"))
