"""Queries over two populations and rank shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as v
from ..operators import ranking as rk
from ..operators import twosample as ts
from ..sources.tables import load
from .catalog import oracle, query

X = """x AS (SELECT event_type AS model_id, left(event_type, 1) AS arch, CASE WHEN user_id % 2 = 0 THEN 'mix' ELSE 'pop' END AS side, event_id,
  CAST(user_id % 7 AS INT) AS label, value + CASE WHEN user_id % 6 = 0 THEN -20 ELSE 0 END AS loss FROM events)"""
# class moments with the fallback for classes of fewer than {least} rows
Z = """, cs AS (SELECT model_id, label, avg(loss) AS m, stddev_pop(loss) AS s, count(*) AS n FROM x WHERE side = 'pop' GROUP BY ALL),
ga AS (SELECT model_id, avg(loss) AS gm, stddev_pop(loss) AS gs FROM x WHERE side = 'pop' GROUP BY ALL),
z AS (SELECT x.*, (loss - CASE WHEN coalesce(n, 0) >= {least} THEN m ELSE gm END) / ((CASE WHEN coalesce(n, 0) >= {least} THEN s ELSE gs END) + 1e-8::DOUBLE) AS z
  FROM x LEFT JOIN cs USING (model_id, label) JOIN ga USING (model_id))"""


def _x(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("model_id"), F.substring("event_type", 1, 1).alias("arch"), F.when(F.col("user_id") % 2 == 0, "mix").otherwise("pop").alias("side"),
        "event_id", (F.col("user_id") % 7).cast("int").alias("label"), (F.col("value") + F.when(F.col("user_id") % 6 == 0, -20.0).otherwise(0.0)).alias("loss"),
    )


def _out(df, places=6):
    return df.select("model_id", F.round("proportion", places).alias("proportion"))


@query("SELECT event_type, round(median(value), 6) AS med, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr FROM events GROUP BY 1")
def iqr_scale(spark, sf_dir):
    out = ts.median_and_iqr(load(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", F.round("med", 6).alias("med"), F.round("iqr", 6).alias("iqr"))


@query(f"""WITH {X}, m AS (SELECT model_id, median(loss) AS med FROM x WHERE side = 'pop' GROUP BY 1), a AS (SELECT model_id, any_value(med) AS med, median(abs(loss - med)) AS mad FROM x JOIN m USING (model_id) WHERE side = 'pop' GROUP BY 1)
SELECT event_id, model_id, round((loss - med) / (1.4826::DOUBLE * mad + 1e-8::DOUBLE), 6) AS z FROM x JOIN a USING (model_id)""")
def robust_zscore(spark, sf_dir):
    return ts.robust_z(_x(spark, sf_dir), "loss").select("event_id", "model_id", F.round("z", 6).alias("z"))


@query(f"WITH {X}{Z.format(least=5)} SELECT event_id, model_id, round(z, 6) AS z FROM z")
def class_zscore(spark, sf_dir):
    return ts.class_z(_x(spark, sf_dir), "loss", "label", 5).select("event_id", "model_id", F.round("z", 6).alias("z"))


R = """, pc AS (SELECT model_id, loss, sum((side = 'pop')::INT) AS c FROM x GROUP BY ALL),
pr AS (SELECT model_id, loss, sum(c) OVER (PARTITION BY model_id ORDER BY loss) AS r, sum(c) OVER (PARTITION BY model_id) AS m FROM pc),
q AS (SELECT x.*, r, m, least(greatest((r + 0.5::DOUBLE) / (m + 1.0::DOUBLE), 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q FROM x JOIN pr USING (model_id, loss) WHERE side = 'mix')"""


@query(f"WITH {X}{R} SELECT event_id, model_id, CAST(r AS BIGINT) AS r, round(q, 6) AS q FROM q")
def reference_rank(spark, sf_dir):
    return ts.reference_quantile(_x(spark, sf_dir), "loss", ["model_id"]).select("event_id", "model_id", "r", F.round("q", 6).alias("q"))


@query(f"""WITH {X}{Z.format(least=2)}, g AS (SELECT -2.5::DOUBLE + i * (2.3::DOUBLE / 23) AS t FROM range(24) r(i)),
f AS (SELECT model_id, t, avg(CASE WHEN side = 'mix' THEN (z <= t)::INT::DOUBLE END) AS fm, avg(CASE WHEN side = 'pop' THEN (z <= t)::INT::DOUBLE END) AS fp FROM z, g GROUP BY ALL),
e AS (SELECT model_id, (fm - fp) / (1 - fp + 1e-9::DOUBLE) AS e, fp FROM f)
SELECT model_id, round(least(greatest(coalesce(median(CASE WHEN fp > 1e-3 AND fp < 0.95 AND e BETWEEN 0 AND 1.5 THEN e END), 0.0::DOUBLE), 0.0), 1.0), 6) AS proportion FROM e GROUP BY 1""")
def proportion_class_cdf(spark, sf_dir):
    return _out(ts.proportion_class_cdf(_x(spark, sf_dir), "loss", "label"))


@query(f"""WITH {X}{R}, t AS (SELECT 0.01::DOUBLE + i * (0.98::DOUBLE / 98) AS t FROM range(99) r(i)), ec AS (SELECT model_id, t, avg((q <= t)::INT::DOUBLE) AS e FROM q, t GROUP BY ALL),
b AS (SELECT 0.3::DOUBLE + i * (2.7::DOUBLE / 27) AS b FROM range(28) r(i) UNION ALL SELECT 3.5::DOUBLE + i * (16.5::DOUBLE / 33) FROM range(34) r(i) UNION ALL SELECT unnest([30.0::DOUBLE, 50, 100])),
p AS (SELECT i / 100.0::DOUBLE AS p FROM range(101) r(i)),
d AS (SELECT model_id, b, t, e, 1 - pow(1 - t, b + 1) - t AS d FROM ec, b), er AS (SELECT model_id, b, p, max(abs(e - (t + p * d))) AS err FROM d, p GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY round(err, 12), b, p) AS rn FROM er)
SELECT model_id, round(err, 6) AS ks_error, round(b, 6) AS ks_exponent, round(p, 6) AS proportion FROM w WHERE rn = 1""")
def proportion_ks_grid(spark, sf_dir):
    out = ts.proportion_ks_grid(ts.reference_quantile(_x(spark, sf_dir), "loss", ["model_id"]))
    return out.select("model_id", *[F.round(c, 6).alias(c) for c in ("ks_error", "ks_exponent", "proportion")])


@query(f"WITH {X}{Z.format(least=5)} SELECT model_id, round(avg(1 / (1 + exp((z + 1) / 0.5::DOUBLE))), 6) AS proportion FROM z WHERE side = 'mix' GROUP BY 1")
def proportion_lira(spark, sf_dir):
    return _out(ts.proportion_lira(_x(spark, sf_dir), "loss", "label"))


@query("""WITH x AS (SELECT event_type || (user_id % 3)::VARCHAR AS model_id, event_type AS arch, value AS loss FROM events),
n AS (SELECT arch, quantile_cont(loss, 0.05) AS q, median(loss) AS med, quantile_cont(loss, 0.75) - quantile_cont(loss, 0.25) + 1e-8::DOUBLE AS iqr FROM x WHERE model_id = arch || '0' GROUP BY 1),
s AS (SELECT x.*, greatest(-(loss - med) / iqr, 0) AS s, (loss < q)::INT::DOUBLE AS lo FROM x JOIN n USING (arch))
SELECT model_id, CASE WHEN right(model_id, 1) <> '0' THEN round(0.5::DOUBLE * avg(lo) + 0.5::DOUBLE * avg(s / (1 + s)), 6) END AS proportion FROM s GROUP BY 1""")
def proportion_cross_null(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    x = e.select(F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("model_id"), F.col("event_type").alias("arch"), F.lit("mix").alias("side"), F.col("value").alias("loss"))
    null = x.select("arch").distinct().withColumn("null_id", F.concat("arch", F.lit("0")))
    return _out(ts.proportion_cross_null(x, "loss", "arch", null))


@query("""WITH x AS (SELECT event_type AS model_id, CASE WHEN user_id % 2 = 0 THEN 'mix' ELSE 'pop' END AS side, user_id, value AS loss FROM events),
s AS (SELECT model_id, side, user_id, avg(loss) AS a, stddev_pop(loss) AS s FROM x GROUP BY ALL),
p AS (SELECT model_id, median(a) AS ma, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) + 1e-8::DOUBLE AS ia, median(s) AS ms, quantile_cont(s, 0.75) - quantile_cont(s, 0.25) + 1e-8::DOUBLE AS i2 FROM s WHERE side = 'pop' GROUP BY 1),
c AS (SELECT model_id, -((a - ma) / ia + (s - ms) / i2) / 2 AS sc FROM s JOIN p USING (model_id) WHERE side = 'mix')
SELECT model_id, round(avg(1 / (1 + exp(-(sc - 0.5::DOUBLE) / 0.5::DOUBLE))), 6) AS proportion FROM c GROUP BY 1""")
def aug_stability(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    x = e.select(F.col("event_type").alias("model_id"), F.when(F.col("user_id") % 2 == 0, "mix").otherwise("pop").alias("side"), "user_id", F.col("value").alias("loss"))
    return _out(ts.proportion_augmented(x, "loss", "user_id"))


from .q_vectors import BASE, _base  # noqa: E402

METRICS = f"""{BASE}, y AS MATERIALIZED (SELECT vec_id, (vec_id % 3)::VARCHAR AS model_id, side, label, CAST(list_position(l, t) - 1 AS INT) AS predicted, p[label + 1] AS true_prob, po[1] AS confidence,
  po[1] - po[2] AS margin, -list_sum(list_transform(p, lambda x: x * ln(x + 1e-12::DOUBLE))) AS entropy, lse - l[label + 1] AS loss, l[label + 1] AS true_logit, lse AS energy,
  (list_position(l, t) - 1 = label) AS correct FROM q)"""


def _metrics(spark, sf_dir):
    l, p, y = F.col("l"), F.col("p"), F.col("label")
    return _base(spark, sf_dir).select(
        "vec_id", (F.col("vec_id") % 3).cast("string").alias("model_id"), "side", "label", v.argmax(l).alias("predicted"), v.at(p, y).alias("true_prob"), v.confidence(p).alias("confidence"),
        v.margin(p).alias("margin"), v.entropy(p).alias("entropy"), v.cross_entropy(l, y).alias("loss"), v.at(l, y).alias("true_logit"), v.log_sum_exp(l).alias("energy"), (v.argmax(l) == y).alias("correct"),
    )


def _gap_sql():
    mean = lambda e: f"(avg(CASE WHEN side = 'mix' THEN {e} END) - avg(CASE WHEN side = 'pop' THEN {e} END))"
    terms = [f"{w}::DOUBLE * {mean(c if c != 'high_conf' else '(confidence > 0.90)::INT::DOUBLE')}" for c, w in ts.GAP_WEIGHTS.items()]
    return f"""WITH {METRICS}, g AS (SELECT model_id, {' + '.join(terms)} AS gap FROM y GROUP BY 1),
h AS (SELECT m.model_id, k.i AS predicted, count(CASE WHEN y.side = 'mix' THEN 1 END) AS a, count(CASE WHEN y.side = 'pop' THEN 1 END) AS b
  FROM (SELECT DISTINCT model_id FROM y) m CROSS JOIN range(10) k(i) LEFT JOIN y ON y.model_id = m.model_id AND y.predicted = k.i GROUP BY ALL),
s AS (SELECT model_id, a / sum(a) OVER (PARTITION BY model_id) + 1e-12::DOUBLE AS p, b / sum(b) OVER (PARTITION BY model_id) + 1e-12::DOUBLE AS q FROM h),
k AS (SELECT model_id, 0.5::DOUBLE * sum(p * ln(p / q) + q * ln(q / p)) AS kl FROM s GROUP BY 1)
SELECT model_id, round(gap + 0.5::DOUBLE * kl, 5) AS score FROM g JOIN k USING (model_id)"""


@query(_gap_sql())
def proportion_gap_score(spark, sf_dir):
    return ts.gap_score(_metrics(spark, sf_dir), "predicted", 10).select("model_id", F.round("score", 5).alias("score"))


def _rank_sql():
    terms = []
    for m, (w, higher) in ts.RANK_WEIGHTS.items():
        share = f"sum((side = 'pop')::INT) OVER (PARTITION BY model_id ORDER BY {m} RANGE UNBOUNDED PRECEDING) / (sum((side = 'pop')::INT) OVER (PARTITION BY model_id))::DOUBLE"
        terms.append(f"{w}::DOUBLE * ({share if higher else '1 - ' + share})")
    # metrics are rounded on both sides, so that ties are the same rows
    cols = ", ".join(f"round({m}, 6) AS {m}" for m in ts.RANK_WEIGHTS)
    return f"WITH {METRICS}, w AS MATERIALIZED (SELECT vec_id, model_id, side, correct, {cols} FROM y), sc AS MATERIALIZED (SELECT vec_id, model_id, side, correct, round({' + '.join(terms)}, 9) AS score FROM w)"


def _ranked(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    m = m.select("vec_id", "model_id", "side", "correct", *[F.round(c, 6).alias(c) for c in ts.RANK_WEIGHTS])
    return m, ts.rank_ensemble(m, "vec_id").withColumn("score", F.round("score", 9))


@query(_rank_sql() + " SELECT vec_id, model_id, round(score, 6) AS score FROM sc")
def rank_ensemble(spark, sf_dir):
    return _ranked(spark, sf_dir)[1].select("vec_id", "model_id", F.round("score", 6).alias("score"))


@query(
    _rank_sql()
    + """, qs AS (SELECT i, 0.70::DOUBLE + 0.25::DOUBLE * i / 24 AS q FROM range(25) r(i)), ta AS (SELECT model_id, i, quantile_cont(score, [0.70 + 0.25 * k / 24 FOR k IN range(25)]::DOUBLE[])[i + 1] AS tau
  FROM sc, qs WHERE side = 'pop' GROUP BY model_id, i),
ex AS (SELECT sc.model_id, i, avg(CASE WHEN side = 'mix' THEN (score >= tau)::INT::DOUBLE END) AS pm, avg(CASE WHEN side = 'pop' THEN (score >= tau)::INT::DOUBLE END) AS pp FROM sc JOIN ta USING (model_id) GROUP BY ALL),
c AS (SELECT model_id, least(greatest((pm - pp) / (1 - pp + 1e-8::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) AS e FROM ex),
n AS (SELECT model_id, quantile_cont(e, 0.2) AS lo, quantile_cont(e, 0.8) AS hi FROM c GROUP BY 1),
a AS (SELECT model_id, median(e) AS alpha FROM c JOIN n USING (model_id) WHERE e >= lo AND e <= hi GROUP BY 1),
g AS (SELECT model_id, avg(CASE WHEN side = 'mix' THEN correct::INT::DOUBLE END) - avg(CASE WHEN side = 'pop' THEN correct::INT::DOUBLE END) AS g FROM sc GROUP BY 1)
SELECT model_id, round(alpha, 5) AS alpha, round(least(greatest(0.75::DOUBLE * alpha + 0.25::DOUBLE * least(greatest(g, 0) * 3.5::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE), 5) AS proportion FROM a JOIN g USING (model_id)"""
)
def proportion_tail_excess(spark, sf_dir):
    m, s = _ranked(spark, sf_dir)
    est = ts.proportion_tail_excess(s).withColumn("alpha", F.col("proportion"))
    out = ts.calibrate_by_accuracy(est, m, "correct")
    return out.select("model_id", F.round("alpha", 5).alias("alpha"), F.round("proportion", 5).alias("proportion"))


# --- shaping by rank: nations within regions, by their share of customers ---

N = "n AS (SELECT n_nationkey AS model_id, n_regionkey AS arch, round(count(c_custkey) / (SELECT max(c) FROM (SELECT count(*) AS c FROM customer GROUP BY c_nationkey))::DOUBLE * 0.8::DOUBLE, 6) AS raw FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY arch ORDER BY raw, model_id) AS rn FROM n)"


def _n(spark, sf_dir):
    c = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("c"))
    n = load(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    top = c.agg(F.max("c").alias("t"))
    raw = F.round(F.coalesce("c", F.lit(0)) / F.col("t") * 0.8, 6)
    return n.crossJoin(F.broadcast(top)).select(F.col("n_nationkey").alias("model_id"), F.col("n_regionkey").alias("arch"), raw.alias("raw"))


@query(f"WITH {N} SELECT model_id, arch, round([0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0][rn], 6) AS shaped FROM r")
def rank_pattern(spark, sf_dir):
    return rk.rank_pattern(_n(spark, sf_dir), "arch", "raw", "model_id", [0.0, 0.25, 0.5, 0.75, 1.0]).select("model_id", "arch", "shaped")


@query(f"WITH {N} SELECT model_id, arch, round(CASE rn WHEN 1 THEN raw WHEN 2 THEN least(1.7::DOUBLE * raw, 1.0::DOUBLE) ELSE 1.0::DOUBLE END, 6) AS shaped FROM r")
def rank_functions(spark, sf_dir):
    out = rk.rank_functions(_n(spark, sf_dir), "arch", "raw", "model_id", [lambda x: x, lambda x: v.clip(x * 1.7), lambda x: F.lit(1.0)])
    return out.select("model_id", "arch", F.round("shaped", 6).alias("shaped"))


@query(f"WITH {N}, t AS (SELECT *, row_number() OVER (PARTITION BY arch ORDER BY raw DESC, model_id DESC) AS d FROM n) SELECT model_id, arch, CASE WHEN d = 1 THEN 1.0::DOUBLE ELSE raw END AS shaped FROM t")
def rank_override(spark, sf_dir):
    return rk.override_greatest(_n(spark, sf_dir), "arch", "raw", "model_id", 1.0).select("model_id", "arch", "shaped")


@query(f"WITH {N} SELECT model_id, CASE WHEN abs(0.0 - raw) <= abs(0.5 - raw) AND abs(0.0 - raw) <= abs(1.0 - raw) THEN 0.0::DOUBLE WHEN abs(0.5 - raw) <= abs(1.0 - raw) THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS shaped FROM n")
def snap_grid(spark, sf_dir):
    return _n(spark, sf_dir).select("model_id", rk.snap(F.col("raw"), [0.0, 0.5, 1.0]).alias("shaped"))


@query(f"WITH {N} SELECT model_id, arch, round(least(greatest(max(raw - 0.1::DOUBLE * rn) OVER (PARTITION BY arch ORDER BY rn) + 0.1::DOUBLE * rn, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS shaped FROM r")
def min_gap(spark, sf_dir):
    return rk.minimum_gap(_n(spark, sf_dir), "arch", "raw", "model_id", 0.1).select("model_id", "arch", F.round("shaped", 6).alias("shaped"))


@query(f"WITH {N} SELECT model_id, round(least(greatest(0.5::DOUBLE * (0.70::DOUBLE * [0.05::DOUBLE, 0.275, 0.5, 0.725, 0.95][rn] + 0.30::DOUBLE * raw * 2) + 0.5::DOUBLE * 0.4::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 6) AS shaped FROM r")
def soft_snap(spark, sf_dir):
    n = _n(spark, sf_dir).withColumn("prior", F.lit(0.4))
    return rk.soft_snap(n, "arch", "raw", "model_id", "prior", [0.05, 0.275, 0.5, 0.725, 0.95]).select("model_id", F.round("shaped", 6).alias("shaped"))


@query(f"WITH {N} SELECT model_id, round(CASE WHEN model_id % 5 = 0 THEN 0.25::DOUBLE ELSE least(least(1.7::DOUBLE * raw, 1.0::DOUBLE) * 0.5::DOUBLE + raw * 0.5::DOUBLE + 0.05::DOUBLE, 0.9::DOUBLE) END, 6) AS shaped FROM n")
def blend_override(spark, sf_dir):
    mixed = rk.push(0.5 * v.clip(F.col("raw") * 1.7) + 0.5 * F.col("raw"), 0.05, 0.9)
    return _n(spark, sf_dir).select("model_id", F.round(F.coalesce(F.when(F.col("model_id") % 5 == 0, 0.25), mixed), 6).alias("shaped"))


@query(f"""WITH {N}, p AS (SELECT model_id, pow(raw - (SELECT min(raw) FROM n) + 1e-12::DOUBLE, 1.35::DOUBLE) AS p FROM n), c AS (SELECT model_id, least(greatest(p / ((SELECT sum(p) FROM p) + 1e-12::DOUBLE), 0.001::DOUBLE), 0.95::DOUBLE) AS c FROM p)
SELECT model_id, round(c / (SELECT sum(c) FROM c), 6) AS shaped FROM c""")
def power_normalise(spark, sf_dir):
    return rk.power_normalise(_n(spark, sf_dir), "raw").select("model_id", F.round("shaped", 6).alias("shaped"))


@query(f"WITH {N}, l AS (SELECT arch, raw, lag(raw) OVER (PARTITION BY arch ORDER BY model_id) AS b FROM n) SELECT arch, count(CASE WHEN raw + 1e-9 < b THEN 1 END) AS n_violations FROM l GROUP BY 1")
def monotone_check(spark, sf_dir):
    return rk.monotone_violations(_n(spark, sf_dir), "arch", "model_id", "raw")


@query(f"WITH {N}, s AS (SELECT model_id, unnest([raw, CASE WHEN model_id % 2 = 0 THEN raw * 0.5::DOUBLE END, 0.3::DOUBLE]) AS x FROM n) SELECT model_id, round(median(x), 6) AS proportion FROM s WHERE x IS NOT NULL GROUP BY 1")
def median_available(spark, sf_dir):
    n = _n(spark, sf_dir).withColumn("half", F.when(F.col("model_id") % 2 == 0, F.col("raw") * 0.5)).withColumn("third", F.lit(0.3))
    return _out(ts.median_of(n, "model_id", ["raw", "half", "third"]))


STRONG = f"""WITH {X}, a AS ({oracle('proportion_class_cdf')}), b AS ({oracle('proportion_ks_grid')})
SELECT model_id, greatest(a.proportion, b.proportion) AS strongest, round(least(greatest(0.5::DOUBLE * a.proportion + 0.5::DOUBLE * b.proportion, 0.0), 1.0), 6) AS blended FROM a JOIN b USING (model_id)"""


@query(STRONG)
def proportion_strongest(spark, sf_dir):
    """The greater of two estimates, and their mean."""
    a, b = proportion_class_cdf(spark, sf_dir), proportion_ks_grid(spark, sf_dir).select("model_id", "proportion")
    strong = ts.strongest(a, b).withColumnRenamed("proportion", "strongest")
    return strong.join(ts.blend(a, b).select("model_id", F.round("proportion", 6).alias("blended")), "model_id")
