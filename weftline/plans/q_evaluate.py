"""Queries over folds, metrics, validators and learners (ML1-ML16, V1-V8, W11, S2, F1, F2, U1-U3, K4)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from .. import streaming as st
from ..functions import text as tx
from ..operators import evaluate as ev
from ..operators import learn as ln
from ..sources.sinks import describe, pending, score_rows
from ..sources.tables import labelled_union, load, spread
from .catalog import query

S = "s AS (SELECT doc_id, quality AS y, round(length(text)::DOUBLE % 97 / 97, 6) AS p, lang FROM documents JOIN labels USING (doc_id))"
PTS = f"{S}, g AS (SELECT p, sum(1 - y) AS f, sum(y) AS t FROM s GROUP BY 1), r AS (SELECT p, sum(f) OVER (ORDER BY p DESC) AS fp, sum(t) OVER (ORDER BY p DESC) AS tp FROM g)"


def _s(spark, sf_dir):
    d = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("quality").alias("y"), F.round((F.length("text") % 97) / 97.0, 6).alias("p"), "lang")


@query("WITH o AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) - 1 AS rn FROM labels) SELECT doc_id, quality, CAST(rn % 5 AS INT) AS fold FROM o")
def stratified_folds(spark, sf_dir):
    return ev.stratified_folds(load(spark, sf_dir, "labels"), "quality", "doc_id").select("doc_id", "quality", "fold")


@query("SELECT doc_id, CAST(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 AS INT) AS bucket, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % 100 < 70 AS public FROM documents")
def hash_split(spark, sf_dir):
    b = ev.hash_bucket(F.col("doc_id"))
    return load(spark, sf_dir, "documents").select("doc_id", b.alias("bucket"), (b < 70).alias("public"))


@query(f"WITH {PTS} SELECT p, CAST(fp AS BIGINT) AS fp, CAST(tp AS BIGINT) AS tp FROM r")
def roc_curve(spark, sf_dir):
    return ev.roc_points(_s(spark, sf_dir), "y", "p").select("p", "fp", "tp")


@query(f"WITH {PTS}, n AS (SELECT max(fp) AS nf, max(tp) AS nt FROM r) SELECT " + ", ".join(f"round(coalesce(max(CASE WHEN fp / nf::DOUBLE <= {t} THEN tp / nt::DOUBLE END), 0.0::DOUBLE), 6) AS {n}" for t, n in ((0.01, "tpr_01"), (0.05, "tpr_05"), (0.25, "tpr_25"))) + " FROM r, n")
def tpr_at_fpr(spark, sf_dir):
    points = ev.roc_points(_s(spark, sf_dir), "y", "p")
    one = lambda t, n: ev.tpr_at_fpr(points, t).select(F.round("tpr", 6).alias(n))
    return one(0.01, "tpr_01").crossJoin(one(0.05, "tpr_05")).crossJoin(one(0.25, "tpr_25"))


@query(f"WITH {S}, k AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0::DOUBLE AS r FROM s), a AS (SELECT lang, sum(CASE WHEN y = 1 THEN r END) AS s, sum(y) AS n1, sum(1 - y) AS n0 FROM k GROUP BY 1) SELECT lang, round((s - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0), 6) AS auc FROM a")
def auc_rank_sum(spark, sf_dir):
    return ev.auc(ev.roc_points(_s(spark, sf_dir), "y", "p", "lang"), "lang").select("lang", F.round("auc", 6).alias("auc"))


@query(f"WITH {S}, c AS (SELECT *, least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS q FROM s) SELECT lang, round(avg(-CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS logloss, round(avg(((p > 0.5)::INT = y)::INT::DOUBLE), 6) AS accuracy FROM c GROUP BY 1")
def logloss_acc(spark, sf_dir):
    out = ev.log_loss_and_accuracy(_s(spark, sf_dir), "y", "p", "lang")
    return out.select("lang", F.round("logloss", 6).alias("logloss"), F.round("accuracy", 6).alias("accuracy"))


@query(f"WITH {S} SELECT lang, round(avg(abs(y - p)), 6) AS mae FROM s GROUP BY 1")
def mean_absolute_error(spark, sf_dir):
    return ev.mean_absolute_error(_s(spark, sf_dir), "y", "p", "lang").withColumn("mae", F.round("mae", 6))


@query("""WITH u AS (SELECT d.doc_id AS id, d.text, quality AS label, CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS source FROM documents d JOIN labels USING (doc_id))
SELECT id, CAST(label AS INT) AS label, source, CAST(row_number() OVER (ORDER BY source, id) - 1 AS BIGINT) AS row_id FROM u""")
def labelled_union_rowid(spark, sf_dir):
    d, l = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    part = lambda q: d.join(l.filter(F.col("quality") == q), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")
    return labelled_union([(part(1), 1, "good"), (part(0), 0, "bad")]).select("id", "label", "source", "row_id")


@query("SELECT doc_id, n_chars FROM documents ANTI JOIN labels USING (doc_id)")
def unlabelled_anti(spark, sf_dir):
    return pending(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def resume_pending(spark, sf_dir):
    done = load(spark, sf_dir, "labels").filter("toxic = 1")
    return pending(load(spark, sf_dir, "documents"), done, "doc_id").select("doc_id", "lang")


@query("SELECT quality, count(*) AS n, CAST(min(doc_id) AS BIGINT) AS first_id, CAST(max(doc_id) AS BIGINT) AS last_id FROM labels GROUP BY 1")
def class_balance(spark, sf_dir):
    return load(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@query("SELECT doc_id AS id, printf('%.6f', least(greatest((n_chars - 500) / 3000.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)) AS score FROM documents")
def submission_rows(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), ((F.col("n_chars") - 500) / 3000.0).alias("score"))
    return score_rows(d)


BROKEN = "b AS (SELECT doc_id + CASE WHEN doc_id % 50 = 7 THEN 1 ELSE 0 END AS id, CASE WHEN doc_id % 40 = 1 THEN 'nan'::DOUBLE WHEN doc_id % 40 = 2 THEN 'inf'::DOUBLE WHEN doc_id % 40 = 3 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS score FROM documents UNION ALL SELECT -1, 0.5::DOUBLE)"


@query(f"""WITH {BROKEN} SELECT 'header' AS rule, 0::BIGINT AS n_violations UNION ALL SELECT 'nan', count(*) FROM b WHERE isnan(score) UNION ALL SELECT 'infinite', count(*) FROM b WHERE isinf(score)
UNION ALL SELECT 'range', count(*) FROM b WHERE isfinite(score) AND score NOT BETWEEN 0 AND 1 UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM b GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'missing_id', count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM b) UNION ALL SELECT 'extra_id', count(*) FROM b WHERE id NOT IN (SELECT doc_id FROM documents)""")
def validate_scores(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id")
    i = F.col("doc_id")
    score = F.when(i % 40 == 1, float("nan")).when(i % 40 == 2, float("inf")).when(i % 40 == 3, 1.5).otherwise(0.5)
    broken = d.select((i + F.when(i % 50 == 7, 1).otherwise(0)).alias("id"), score.alias("score")).union(spark.sql("SELECT -1L, 0.5D"))
    return ev.validate_scores(broken, d)


GRID = """g AS (SELECT doc_id AS id, CASE WHEN doc_id % 90 = 5 AND k = 'PHONE' THEN 'EMAIL' WHEN doc_id % 90 = 6 AND k = 'EMAIL' THEN 'NAME' ELSE k END AS pii_type,
 CASE WHEN doc_id % 30 = 1 THEN NULL WHEN doc_id % 30 = 2 THEN '' WHEN doc_id % 30 = 3 THEN 'short' ELSE text END AS pred FROM documents CROSS JOIN (VALUES ('EMAIL'), ('CREDIT'), ('PHONE')) t(k))"""


@query(f"""WITH {GRID} SELECT 'null' AS rule, count(*) AS n_violations FROM g WHERE pred IS NULL UNION ALL SELECT 'empty', count(*) FROM g WHERE trim(pred) = '' UNION ALL SELECT 'length', count(*) FROM g WHERE length(pred) NOT BETWEEN 10 AND 100
UNION ALL SELECT 'kind', count(*) FROM g WHERE pii_type NOT IN ('EMAIL', 'CREDIT', 'PHONE') UNION ALL SELECT 'duplicate_pair', count(*) FROM (SELECT 1 FROM g GROUP BY id, pii_type HAVING count(*) > 1)
UNION ALL SELECT 'kinds_of_id', count(*) FROM (SELECT id FROM g GROUP BY 1 HAVING list_sort(list(DISTINCT pii_type)) <> ['CREDIT', 'EMAIL', 'PHONE']) UNION ALL SELECT 'rows', abs(count(*) - 2999) FROM g""")
def validate_grid(spark, sf_dir):
    i = F.col("doc_id")
    g = load(spark, sf_dir, "documents").withColumn("k", F.explode(F.array(F.lit("EMAIL"), F.lit("CREDIT"), F.lit("PHONE"))))
    kind = F.when((i % 90 == 5) & (F.col("k") == "PHONE"), "EMAIL").when((i % 90 == 6) & (F.col("k") == "EMAIL"), "NAME").otherwise(F.col("k"))
    pred = F.when(i % 30 == 1, None).when(i % 30 == 2, "").when(i % 30 == 3, "short").otherwise(F.col("text"))
    return ev.validate_predictions(g.select(i.alias("id"), kind.alias("pii_type"), pred.alias("pred")), rows=2999)


@query("SELECT 'left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'right', vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def set_differences(spark, sf_dir):
    return ev.set_differences(load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'mix' ELSE 'pop' END AS side FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('3:' || doc_id), doc_id) AS rn FROM labels)
WHERE rn <= CASE WHEN quality = 1 THEN 30 ELSE 10 END""")
def mixture_sample(spark, sf_dir):
    l = load(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "mix").otherwise("pop").alias("side"))
    return ln.mixture_sample(l, "side", "doc_id", 40, 0.75, 3).drop("draw")


@query("SELECT r_regionkey, r_name, CAST(i AS INT) AS copy FROM region CROSS JOIN range(3) t(i)")
def repeat_rows(spark, sf_dir):
    return ln.repeat_rows(load(spark, sf_dir, "region").select("r_regionkey", "r_name"), 3)


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS i FROM labels), d AS (SELECT range AS draw, ('0x' || substr(md5('42:' || range), 1, 12))::BIGINT % (SELECT count(*) FROM labels) AS i FROM range(100))
SELECT draw, doc_id, quality, toxic FROM d JOIN o USING (i)""")
def resample_rows(spark, sf_dir):
    return ln.resample(load(spark, sf_dir, "labels"), "doc_id", 100).select("draw", "doc_id", "quality", "toxic")


def _features(spark, sf_dir):
    """The fifteen text statistics of labelled documents, and their labels."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    return tx.stylometry(spread(load(spark, sf_dir, "documents")).join(labels.select("doc_id"), "doc_id", "left_semi")).join(labels, "doc_id")


@query()
def gbt_cv_oof(spark, sf_dir):
    return ln.boosted_oof(_features(spark, sf_dir), tx.STYLOMETRY, "quality", "doc_id", draws="key")[0]


@query()
def gbt_test_scores(spark, sf_dir):
    """Documents without a label, scored by the mean of the folds' models."""
    rest = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return ln.boosted_oof(_features(spark, sf_dir), tx.STYLOMETRY, "quality", "doc_id", tx.stylometry(rest), draws="key")[1]


@query()
def feature_importance(spark, sf_dir):
    return ln.top_features(ln.boosted_oof(_features(spark, sf_dir), tx.STYLOMETRY, "quality", "doc_id", draws="key")[2])


@query()
def ridge_rf_blend(spark, sf_dir):
    f = ln.held_once(_features(spark, sf_dir).withColumn("y", F.col("quality").cast("double")))
    return ln.ridge_and_forest(f, f.drop("y", "quality"), tx.STYLOMETRY, "y", "doc_id", prior=0.5)


@query("""WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM events), g AS (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg((value > 100)::INT::DOUBLE), 6) AS high_rate FROM events GROUP BY ALL)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n, total, high_rate FROM g, m WHERE h + INTERVAL 1 HOUR <= w""")
def stream_rates(spark, sf_dir):
    """Streaming counts and rates by hour; windows behind the watermark, as append mode gives them."""
    top = f"{st.shared_folder(spark)}/stream-{os.urandom(8).hex()}"
    schema = load(spark, sf_dir, "events").schema
    stream = st.windowed_rates(st.file_stream(spark, sf_dir, schema, "events.parquet"), "ts", "event_type", "value")
    st.run_once(stream, f"{top}/out", f"{top}/checkpoint")
    start = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return spark.read.parquet(f"{top}/out").select(start, "event_type", "n", F.round("total", 4).alias("total"), F.round("high_rate", 6).alias("high_rate"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct FROM events" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")))
def table_profile(spark, sf_dir):
    return describe(load(spark, sf_dir, "events"))
