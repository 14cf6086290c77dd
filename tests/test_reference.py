"""Golden cases, worked out by hand or anew in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import pii as p
from weftline.functions import text as tx
from weftline.functions import vectors as v
from weftline.operators import convo as cv
from weftline.operators import evaluate as ev
from weftline.operators import pii as op
from weftline.operators import ranking as rk
from weftline.operators import tokens as tk
from weftline.operators import twosample as ts
from weftline.sources import tables

STYLE = {
    "The cat sat. The cat ran away!": [30, 7, 5, 0.714286, 3.142857, 0.349927, 3.447743, 2.235926, 0.333333, 0.066667, 0, 0.066667, 0, 2, 0.142857],
    "Été à Paris: 42 cafés?\nOui, 42 cafés.": [37, 8, 6, 0.75, 3.25, 1.47902, 4.134469, 2.5, 0.285714, 0.108108, 0.027027, 0.081081, 0.108108, 2, 0.25],
    "": [0] * 15,
}
ORDER = "n_chars n_words n_unique_words ttr avg_word_len std_word_len char_entropy word_entropy bigram_repeat_rate punct_rate newline_rate uppercase_rate digit_rate n_sentences sent_burstiness".split()


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_stylometry(spark):
    rows = spark.createDataFrame(list(enumerate([*STYLE, None])), "doc_id long, text string")
    out = {r.doc_id: r for r in tx.stylometry(rows).collect()}
    for i, want in enumerate([*STYLE.values(), [0] * 15]):
        got = [out[i][f"stat_{c}"] for c in ORDER]
        assert got == pytest.approx(want, abs=1e-6), i


def test_similarity(spark):
    pairs = [("kitten", "sitting", 0.571429), ("abc", "abc", 1.0), ("", "abc", 0.0), ("", "", 0.0), ("+15551234567", "+15557654321", 0.5), (None, "x", 0.0)]
    df = spark.createDataFrame(pairs, "a string, b string, want double").select(p.similarity(F.col("a"), F.col("b")), p.similarity(F.col("b"), F.col("a")), "want")
    for got, back, want in df.collect():
        assert got == pytest.approx(want, abs=1e-6) and back == got


def test_roc(spark):
    rows = list(zip([1, 1, 0, 1, 0, 0, 1, 0], [0.9, 0.8, 0.8, 0.7, 0.6, 0.5, 0.4, 0.1]))
    points = ev.roc_points(spark.createDataFrame(rows, "y int, s double"), "y", "s")
    assert sorted(values(points, "fp", "tp")) == [(0, 1), (1, 2), (1, 3), (2, 3), (3, 3), (3, 4), (4, 4)]
    for target, want in ((0.01, 0.25), (0.25, 0.75), (0.5, 0.75)):
        assert ev.tpr_at_fpr(points, target).first().tpr == pytest.approx(want)
    assert ev.auc(points).first().auc == pytest.approx(0.71875)


def test_roc_with_collinear_ties(spark):
    rows = list(zip([1, 0] * 4, [0.9, 0.9, 0.8, 0.8, 0.7, 0.7, 0.6, 0.6]))
    points = ev.roc_points(spark.createDataFrame(rows, "y int, s double"), "y", "s")
    assert ev.tpr_at_fpr(points, 0.5).first().tpr == 0.5
    assert ev.tpr_at_fpr(points, 0.5, drop_intermediate=True).first().tpr == 0.25
    single = ev.roc_points(spark.createDataFrame([(1, 0.5)], "y int, s double"), "y", "s")
    assert ev.tpr_at_fpr(single, 0.5).first().tpr == 0.0


def samples(spark, mix, pop):
    rows = [("m", "mix", i, 0, float(x)) for i, x in enumerate(mix)] + [("m", "pop", i, 0, float(x)) for i, x in enumerate(pop)]
    return spark.createDataFrame(rows, "model_id string, side string, id int, label int, loss double")


def test_reference_rank(spark):
    df = samples(spark, [0, 2, 4, 6], [1, 2, 2, 3, 5])
    q = ts.reference_quantile(df, "loss", ["model_id"]).orderBy("loss")
    assert [r.q for r in q.collect()] == pytest.approx([0.5 / 6, 3.5 / 6, 4.5 / 6, 5.5 / 6])
    share = ts.rank_fraction(df, "loss", ["model_id"], "r").filter("side = 'mix'").orderBy("loss")
    assert [r.r for r in share.collect()] == pytest.approx([0, 0.6, 0.8, 1])
    z = ts.robust_z(df, "loss").filter("side = 'mix'").orderBy("loss")
    assert [r.z for r in z.collect()] == pytest.approx([-1.349, 0, 1.349, 2.698], abs=1e-3)


def test_rolling(spark):
    rows = [("a", i - 1, float(i * i)) for i in range(1, 21)] + [("b", i, float(i)) for i in range(15)]
    out = dict(values(tk.rolling_std(spark.createDataFrame(rows, "id string, pos int, logp double"), "id"), "id", "lp_burstiness"))
    assert out["a"] == pytest.approx(29.745588, abs=1e-6) and out["b"] == 0


def test_rank_shaping(spark):
    df = spark.createDataFrame([("0", "00", 0.09), ("0", "01", 0.348), ("0", "02", 0.47)], "arch string, id string, raw double")
    shaped = lambda d: [x for (x,) in values(d.orderBy("id"), "shaped")]
    assert shaped(rk.rank_pattern(df, "arch", "raw", "id", [0.0, 0.5, 1.0])) == [0, 0.5, 1]
    assert [x for (x,) in values(df, v.clip(F.col("raw") * 1.7))] == pytest.approx([0.153, 0.5916, 0.799])
    assert [x for (x,) in values(df, rk.snap(F.col("raw"), [0.0, 0.5, 1.0]))] == [0, 0.5, 0.5]
    close = spark.createDataFrame([("0", "00", 0.30), ("0", "01", 0.35), ("0", "02", 0.95)], "arch string, id string, raw double")
    assert shaped(rk.minimum_gap(close, "arch", "raw", "id", 0.1)) == pytest.approx([0.30, 0.40, 0.95])


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, map(float, x)))
    logits = a(2, 1, 0)
    got = one(spark, v.entropy(a(0.7, 0.2, 0.1)), v.log_sum_exp(logits), v.cross_entropy(logits, F.lit(1)))
    assert got == pytest.approx((0.801819, 2.407606, 1.407606), abs=1e-6)
    assert one(spark, v.last_layer_gradient_norm(v.softmax(logits), F.lit(1), a(3, 4)))[0] == pytest.approx(5.152498, abs=1e-6)
    assert one(spark, v.argmax(a(1, 3, 3)), v.rank_of(a(1, 3, 3), F.lit(0))) == (1, 3)


def test_pii(spark):
    assert one(spark, p.luhn(F.lit("4111111111111111")), p.normal_card(F.lit("4111111111111111"))) == (True, "4111 1111 1111 1111")
    bad = ["4111111111111111", "0123 4567 8901 2345", "1234567812345678"]
    assert [one(spark, p.cards(F.lit(x)))[0] for x in bad] == [[], [], []]
    assert one(spark, p.emails(F.lit("a.b@example.com")), p.emails(F.lit("jane.doe@mailer.net."))) == ([], ["jane.doe@mailer.net"])
    assert one(spark, p.normal_phone(F.lit("+1 (555) 382-4671")))[0] == "+15553824671"
    assert one(spark, p.phones(F.lit("card 4539 7612 9087 3456 and phone 4539761290")))[0] == []
    twice = p.redact(p.redact(F.lit("x jane@mailer.net y 4539 7612 9087 3456")))
    assert one(spark, twice)[0] == one(spark, p.redact(F.lit("x jane@mailer.net y 4539 7612 9087 3456")))[0]
    assert one(spark, p.repair_length(F.lit("ab@c.com"), F.lit("EMAIL"), F.lit("d")), p.fit_length(F.lit("abc"))) == ("ab@c.comx", "abcxxxxxxx")


def test_score_validator(spark):
    want = spark.range(1, 6)
    ok = [(i, 0.5) for i in range(1, 6)]
    cases = {
        None: ok, "duplicate_id": [*ok, (1, 0.5)], "missing_id": ok[1:], "extra_id": [*ok, (9, 0.5)], "nan": [(1, math.nan), *ok[1:]],
        "infinite": [(1, math.inf), *ok[1:]], "range": [(1, -0.1), (2, 1.1), *ok[2:]],
    }
    for rule, rows in cases.items():
        out = ev.validate_scores(spark.createDataFrame(rows, "id long, score double"), want)
        assert {r.rule for r in out.collect() if r.n_violations} == ({rule} - {None})
    renamed = spark.createDataFrame(ok, "id long, points double")
    assert ev.validate_scores(renamed.withColumnRenamed("points", "score").select("score", "id"), want).filter("rule = 'header'").first().n_violations == 1


def test_estimators(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    pop = rng.normal(size=3000)
    same = samples(spark, rng.normal(size=3000), pop)
    assert ts.proportion_class_cdf(same, "loss", "label").first().proportion < 0.08
    moved = samples(spark, np.concatenate([rng.normal(size=2100), rng.normal(-6, 0.5, 900)]), pop)
    assert ts.proportion_class_cdf(moved, "loss", "label").first().proportion == pytest.approx(0.3, abs=0.05)


def test_ks_grid_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    q = np.concatenate([rng.random(300), rng.random(100) ** 6])
    df = spark.createDataFrame([("m", float(x)) for x in q], "model_id string, q double")
    got = ts.proportion_ks_grid(df).first()
    t = np.linspace(0.01, 0.99, 99)
    e = np.array([(q <= x).mean() for x in t])
    bs = np.concatenate([np.linspace(0.3, 3.0, 28), np.linspace(3.5, 20.0, 34), [30.0, 50.0, 100.0]])
    best = min((round(float(np.abs(e - (t + pp * (1 - (1 - t) ** (b + 1) - t))).max()), 12), b, pp) for b in bs for pp in np.linspace(0, 1, 101))
    assert (got.ks_error, got.proportion) == pytest.approx((best[0], best[2]), abs=1e-9)


def test_folds_partition_and_balance(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(100)], "id int, y int")
    folds = ev.stratified_folds(df, "y", "id")
    assert folds.count() == 100
    sizes = [r["count"] for r in folds.filter("y = 1").groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_parse_turns(spark):
    raw = ['[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]', '{"question":"q","answer":"a"}', "plain", None, '[{"instruction":"i","output":"o"},{}]']
    rows = spark.createDataFrame([(x,) for x in raw], "c string").select(cv.parse_turns(F.col("c")).alias("t")).collect()
    assert [[tuple(t) for t in r.t] for r in rows] == [[("q", ""), ("", "a")], [("q", "a")], [("plain", "")], [], [("i", "o")]]


def test_length_grouping(spark):
    out = cv.length_grouped(spark.range(64).select("id", (F.col("id") % 9).alias("n")), "id", "n", 4, 4).collect()
    assert sorted(r.id for r in out) == list(range(64))
    assert cv._even_chunks([9, 5, 4, 3], 2) == [0, 1, 1, 0]


def test_json_sources(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": 1, "text": "a"}\n\n{"id": 2, "text": "b"}\n')
    assert tables.read_records(spark, str(tmp_path / "r.jsonl")).count() == 2
    (tmp_path / "m.json").write_text('{"a": {"x": 1}, "b": {"x": 2}}')
    assert sorted(values(tables.read_json_map(spark, str(tmp_path / "m.json"), "struct<x:int>"), "key", "value.x")) == [("a", 1), ("b", 2)]
    assert tables.pick_column(["User ID", "Long-Text"], ["user_id"]) == "User ID"
    assert tables.pick_column(["User ID", "Long-Text"], ["text"], ["text"]) == "Long-Text"
    with pytest.raises(ValueError):
        tables.require(spark.range(1), "text")


def test_profile_and_consensus(spark):
    rows = [(1, "EMAIL", "A@x.org", 1.0), (1, "EMAIL", "a@x.org", 0.5), (1, "EMAIL", "b@x.org", 1.7), (1, "PHONE", "+1555", 1.0)]
    out = {r.pii_type: r for r in op.consensus(spark.createDataFrame(rows, "id int, pii_type string, cand string, score double"), "id").collect()}
    assert out["EMAIL"].pred == "A@x.org" and out["EMAIL"].total == pytest.approx(1.8)


def test_benchmark_similarity_of_whole_texts(spark, tmp_path):
    """Passages that differ only after 60 characters, or in letters outside ASCII."""
    import __spark_entry__ as entry

    texts = ["x" * 80 + "one", "x" * 80 + "two four", "é" * 70, "e" * 70, "e" * 70]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.item_id: r.sim for r in entry.queries()["benchmark_similarity_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: round(1 - distance(a, b) / max(len(a), len(b)), 6) for i, (a, b) in enumerate(zip(texts, texts[1:]))}
    assert got[0] < 1 and got[2] == 0
