"""Results that must equal DuckDB's to the sign of a zero and the edge of a word; learners over larger tables."""

import inspect
import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.functions import vectors as v
from weftline.llm import simhash, simhash_wide
from weftline.operators import boosting
from weftline.operators import learn as ln


def test_rounding_keeps_the_sign_of_zero(spark):
    # a tie whose scaled value is whole and a half, one just below a half, what is too large to scale
    values = [-0.000003, 0.000003, -0.0, 0.0, -0.000005, 1.000005, -2.5e-5, 0.49999999999999994e-5, 1e307, -1e307, math.inf, -math.inf, math.nan, None, 1e15 + 0.3]
    got = spark.createDataFrame([(values,)], "x array<double>").select(F.transform("x", lambda x: v.rounded(x, 5)).alias("x")).first().x
    want = duckdb.connect().execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, 5))", [values]).fetchone()[0]
    assert repr(got) == repr(want) and "-0.0" in repr(want)


@pytest.mark.parametrize("name", ["bilinear_resize", "channel_normalise", "image_normalise"])
def test_lists_equal_their_sql_to_the_sign(spark, tmp_path, name):
    import __spark_entry__ as entry

    # components that come to just below zero after scaling by each query
    rows = [(i, [(-1) ** i * 1e-7 * (k + 1) + 0.05 * (i > 1) for k in range(64)], i) for i in range(6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]}) order by vec_id").fetchall()
    assert [repr(tuple(r)) for r in got.orderBy("vec_id").collect()] == [repr(r) for r in want]


@pytest.mark.parametrize("name", ["pii_name_extract", "pii_extract_card", "pii_extract_phone", "pii_redact"])
def test_edges_of_words_are_those_of_the_sql(spark, tmp_path, name):
    import __spark_entry__ as entry

    texts = [
        "seen. Hationea Ciónñrrado de llbo", "Eredon Enötz den", "éAnna Berg came", "Anna Bergé x", "Anna\vBerg went", "for Anna\vBerg", "Anna\tBerg\nLee's",
        "é4556737586899855 x", "4556737586899855é", "x4556737586899855", "call 12345\v67890 12", "tel 030 1234567ñ", "", "no name", None,
    ]
    spark.createDataFrame([(5 * i + 4, t, "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_folds_in_tasks_are_those_from_arrays(spark):
    """Bins that travel packed, and sums of the smaller side, give the trees of the plain way."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(500, 3)), 2)
    y = (x[:, 0] + 0.5 * rng.normal(size=500) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y int")
    how = dict(rounds=6, patience=3, leaves=6)
    fit = {most: ln.boosted_oof(df, ["a", "b", "c"], "y", "id", most_rows=most, draws="key", **how) for most in (1_000, 100)}
    small, wide = ({r.id: (r.fold, r.score) for r in fit[most][0].collect()} for most in (1_000, 100))
    assert small == wide and len({s for _, s in small.values()}) > 10
    assert sorted(map(tuple, fit[1_000][2].collect())) == sorted(map(tuple, fit[100][2].collect()))


@pytest.mark.parametrize("name", ["gbt_cv_oof", "feature_importance", "gbt_test_scores", "ridge_rf_blend"])
def test_learners_work_out_features_once(spark, monkeypatch, name):
    """Every learner's input is a written table; text statistics aren't part of what it reads again and again."""
    from weftline.plans import q_evaluate

    read = []

    class Stop(Exception):
        pass

    def note(df, *_, **__):
        read.append(df._jdf.queryExecution().optimizedPlan().toString())
        raise Stop

    monkeypatch.setattr(ln, "feature_cuts", note)
    monkeypatch.setattr(ln, "ridge_and_forest", note)
    with pytest.raises(Stop):
        getattr(q_evaluate, name)(spark, "/root/testdata/sf0.001")
    assert "regexp" not in read[0] and ("ExistingRDD" in read[0] or "LogicalRDD" in read[0])


def test_sixty_thousand_rows_are_learned_within_tasks():
    """Beyond 50,000 rows the default took thousands of Spark jobs, which no time limit allows."""
    assert inspect.signature(ln.boosted_oof).parameters["most_rows"].default >= 1_000_000
    rng = np.random.default_rng(5)
    b, y = rng.integers(0, 255, (60_000, 15)).astype(np.uint16), rng.integers(0, 2, 60_000).astype(float)
    began = time.process_time()
    boosting.BoostedTrees(rounds=10, patience=100).fit_bins(b[:50_000], y[:50_000], b[50_000:], y[50_000:], np.arange(50_000), [np.arange(254.0)] * 15)
    assert time.process_time() - began < 20


def test_near_duplicates_of_the_pipeline_link_by_fingerprint(spark):
    """Texts whose fingerprints are near link though their sets of shingles aren't similar; so do similar sets whose fingerprints aren't near."""
    phrase = "one two three four five six seven " * 100
    tail = lambda c: " ".join(f"{c}{i}" for i in range(12))
    words = [f"w{i}" for i in range(80)]
    changed = words[:40] + ["other"] + words[41:]
    rows = [(3, phrase + tail("a")), (4, phrase + tail("b")), (5, tail("x")), (6, tail("y")), (7, " ".join(words)), (8, " ".join(changed)), (9, phrase + tail("c"))]
    apart = lambda t, u: ((simhash.fingerprint(t) ^ simhash.fingerprint(u)) & (1 << 64) - 1).bit_count()
    texts, sets = dict(rows), {i: simhash_wide.shingles(t) for i, t in rows}
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    assert apart(texts[3], texts[4]) <= 2 and apart(texts[4], texts[9]) <= 2 and not alike(3, 4) and not alike(4, 9)
    assert apart(texts[7], texts[8]) > 2 and alike(7, 8) and apart(texts[5], texts[6]) > 2 and not alike(5, 6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {3, 5, 6, 7}
