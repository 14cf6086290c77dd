"""Sources and sinks on files made here; learners, segments and token features against plain Python or numpy."""

import io
import math
import json
import math
import re
import tarfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.functions import pii as p
from weftline.functions import text as tx
from weftline.operators import boosting, boosting_sums, geometry, ordered
from weftline.operators import convo as cv
from weftline.operators import evaluate as ev
from weftline.operators import learn as ln
from weftline.operators import pii as op
from weftline.operators import tokens as tk
from weftline.sources import annotations, archives, sinks, tables

SF = "/root/testdata/sf0.001"


# --- files -------------------------------------------------------------------


def test_json_csv_and_cache(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "text": "x"}\n\n{"id": 2, "text": "y"}\n')
    assert sorted(map(tuple, tables.read_records(spark, f"{tmp_path}/a.jsonl").collect())) == [(1, "x"), (2, "y")]
    (tmp_path / "b.json").write_text('[{"k": 1}, {"k": 2}]')
    assert {r.k for r in tables.read_json_array(spark, f"{tmp_path}/b.json", "k int").collect()} == {1, 2}
    (tmp_path / "c.json").write_text('{"a": {"n": 1}, "b": {"n": 2}}')
    assert {(r.key, r.value.n) for r in tables.read_json_map(spark, f"{tmp_path}/c.json", "struct<n:int>").collect()} == {("a", 1), ("b", 2)}
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, score double")
    sinks.write_csv(df, f"{tmp_path}/d.csv", single=True)
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/d.csv", "id long, score double").collect())) == [(1, 0.5), (2, 0.25)]
    sinks.append_parquet(df, f"{tmp_path}/e")
    sinks.append_parquet(df, f"{tmp_path}/e")
    assert tables.read_parquet_with_origin(spark, f"{tmp_path}/e/*.parquet").count() == 4
    sinks.write_json_lines(df, f"{tmp_path}/f")
    assert spark.read.json(f"{tmp_path}/f").count() == 2
    made = []
    make = lambda: (made.append(1), df)[1]
    for _ in range(2):
        assert tables.read_or_make(spark, f"{tmp_path}/g", make).count() == 2
    assert made == [1]
    for name in ("s_1.csv", "s_2.csv", "s_3_old.csv"):
        (tmp_path / name).write_text("x")
    assert sinks.latest_file(spark, f"{tmp_path}/s_*.csv", "_old.csv").endswith("s_2.csv")


def test_score_file(spark, tmp_path):
    ids = spark.range(1, 4).withColumnRenamed("id", "doc_id")
    good = {r: 0 for r in ("extension", "size", "header", "nan", "infinite", "range", "duplicate_id", "missing_id", "extra_id")}
    check = lambda path: {r.rule: r.n_violations for r in ev.validate_score_file(spark, str(path), ids).collect()}
    (tmp_path / "ok.csv").write_text("id,score\n1,0.5\n2,0\n3,1\n")
    assert check(tmp_path / "ok.csv") == good
    (tmp_path / "bad.txt").write_text("id,score\n1,0.5\n1,x\n4,7\n")
    assert check(tmp_path / "bad.txt") == {**good, "extension": 1, "nan": 1, "range": 1, "duplicate_id": 1, "missing_id": 2, "extra_id": 1}
    (tmp_path / "head.csv").write_text("id,p\n1,0.5\n")
    assert check(tmp_path / "head.csv") == {"extension": 0, "size": 0, "header": 1}
    (tmp_path / "big.csv").write_text("id,score\n" + "1,0.50000000000000\n" * 600_000)
    assert check(tmp_path / "big.csv")["size"] == 1


def _tar(path, members):
    with tarfile.open(path, "w") as tar:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_tar_shards(spark, tmp_path):
    about = lambda n: json.dumps({"status": "success", "n": n}).encode()
    _tar(tmp_path / "0.tar", [("a/1.jpg", b"one"), ("a/1.json", about(1)), ("a/2.jpg", b"two"), ("a/3.json", about(3)), ("readme.txt", b"x")])
    _tar(tmp_path / "1.tar", [("4.json", about(4)), ("4.jpg", b"four"), ("5.jpg", b"five"), ("5.json", b"{broken")])
    whole = (tmp_path / "1.tar").read_bytes()
    (tmp_path / "2.tar").write_bytes(whole[:700])
    (tmp_path / "3.tar").write_bytes(b"not an archive")
    samples = archives.read_tar_shards(spark, str(tmp_path))
    good = archives.sound(samples, "status string, n int").collect()
    assert {(r.shard, r.key, bytes(r.media), r.about.n) for r in good} == {("0.tar", "a/1", b"one", 1), ("1.tar", "4", b"four", 4)}
    found = {r.shard: r.n_faults for r in archives.faults(samples).collect()}
    assert found["0.tar"] == 2 and found["1.tar"] == 1 and found["2.tar"] >= 1 and found["3.tar"] == 1


def test_columns_and_picks(spark):
    assert tables.feature_columns(["id", "mix_a", "pop_a", "gap_b", "p"], ["id", "p"]) == ["mix_a", "pop_a", "gap_b"]
    assert tables.feature_columns(["id", "mix_a", "pop_a"], starts=["mix_"]) == ["mix_a"]
    assert tables.pick_column(["My-Id", "Text Body"], ["my_id"]) == "My-Id" and tables.pick_column(["x", "Text Body"], ["q"], ["text"]) == "Text Body"
    options = F.array(*map(F.lit, "abc"))
    picks = [r[0] for r in spark.range(50).select(annotations.pick_by_hash(options, F.col("id"))).collect()]
    assert set(picks) == set("abc") and picks == [r[0] for r in spark.range(50).select(annotations.pick_by_hash(options, F.col("id"))).collect()]


# --- token features ----------------------------------------------------------


def test_token_features_of_a_models_rows(spark):
    """Rows (id, pos, logp, entropy, rank) of any model, in any order, against numpy."""
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for i, n in enumerate((40, 17, 16, 15, 2, 1)):
        logp, entropy, rank = -rng.exponential(4, n), rng.random(n), rng.integers(1, 3000, n)
        rows += [(i, int(k), float(logp[k]), float(entropy[k]), int(rank[k])) for k in rng.permutation(n)]
        means = np.convolve(logp, np.ones(16) / 16, "valid") if n >= 16 else np.zeros(0)
        want[i] = {
            "lp_n_tokens": n, "lp_mean": logp.mean(), "lp_std": logp.std(), "lp_min": logp.min(), "lp_max": logp.max(), "lp_ppl": math.exp(-logp.mean()), "lp_log_ppl": -logp.mean(),
            "lp_ent_mean": entropy.mean(), "lp_ent_std": entropy.std(), "lp_ent_p25": np.quantile(entropy, 0.25), "lp_ent_p75": np.quantile(entropy, 0.75),
            **{f"lp_p{q}": np.quantile(logp, q / 100) for q in (10, 25, 50, 75, 90)}, **{f"lp_rank_top{k}": (rank <= k).mean() for k in (10, 100, 1000)},
            "lp_rank_mean": rank.mean(), "lp_rank_median": np.median(rank), "lp_spike_rate": (logp < -10).mean(), "lp_high_conf_rate": (logp > math.log(0.5)).mean(),
            "lp_burstiness": means.std() if len(means) else 0.0,
        }
    want[5] = {c: 0.0 for c in want[5]}  # fewer than two tokens
    want[6] = {c: 0.0 for c in want[5]}  # none
    tokens = spark.createDataFrame(rows, "id long, pos int, logp double, entropy double, rank int")
    out = tk.full_summary(tk.token_arrays(tokens, "id"), spark.range(7), "id").collect()
    assert len(out) == 7 and len(out[0]) == 25
    for r in out:
        assert {c: r[c] for c in want[r.id]} == pytest.approx(want[r.id], abs=1e-9)


def test_rare_words_are_joined_too(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda: sorted((r.doc_id, r.pos, r.word, round(r.logp, 9), r["rank"]) for r in tk.unigram_tokens(docs, tx.words(F.col("text"))).collect())
    whole = rows()
    monkeypatch.setattr(tk, "HEAD_WORDS", 50)
    assert rows() == whole


# --- segments, shards, batches -------------------------------------------------


def plain_segments(ids, labels, starts, ends):
    parts, inside, held = [], "text", ([], [])
    opens, closes = {t: n for n, t in starts.items()}, {t: n for n, t in ends.items()}

    def flush():
        nonlocal held
        if held[0]:
            parts.append((inside, *held))
        held = ([], [])

    for x, y in zip(ids, labels):
        if closes.get(x) == inside:
            flush()
            inside = "text"
        held[0].append(x)
        held[1].append(y if inside == "text" else -100)
        if inside == "text" and x in opens:
            flush()
            inside = opens[x]
    flush()
    return parts


def test_segments(spark):
    starts, ends = {"image": 1, "audio": 3}, {"image": 2, "audio": 4}
    rng = np.random.default_rng(3)
    rows = [(i, [int(x) for x in rng.choice([1, 2, 3, 4, 7, 8, 9], n)]) for i, n in enumerate(rng.integers(0, 30, 120))]
    rows += [(900, [1, 2]), (901, [1]), (902, [7, 1, 8, 8]), (903, [])]
    df = spark.createDataFrame(rows, "id long, ids array<int>").withColumn("labels", F.transform("ids", lambda x: x * 10))
    df = df.withColumn("parts", cv.segments(F.col("ids"), F.col("labels"), starts, ends)).withColumn("mask", cv.modality_mask(F.col("parts"), "image"))
    for r in df.collect():
        want = plain_segments(r.ids, r.labels, starts, ends)
        assert [(q.modality, q.ids, q.labels) for q in r.parts or []] == want
        assert (r.mask or []) == [int(m == "image") for m, ids, _ in want for _ in ids]


def test_shards_part_all_rows(spark):
    df = spark.range(103)
    for run in (False, True):
        parts = [[r.id for r in cv.shard_rows(df, "id", 4, i, run).collect()] for i in range(4)]
        assert sorted(x for part in parts for x in part) == list(range(103)) and {len(part) for part in parts} <= {25, 26}


def test_length_grouped(spark):
    """Every row once; chunks of a megabatch as even as the greedy rule makes them, by plain Python."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = cv.length_grouped(docs, "doc_id", "n_chars", 8, 4).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.collect())
    groups = {}
    for r in out:
        groups.setdefault(r.megabatch, []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: (-r.n_chars, r.doc_id))
        room, load = [len(rows) // 4] * 4, [0] * 4
        for i, r in enumerate(rows):
            if len(rows) % 4:
                assert r.chunk == i % 4
                continue
            k = min((c for c in range(4) if room[c]), key=lambda c: load[c])
            assert r.chunk == k
            room[k], load[k] = room[k] - 1, load[k] + r.n_chars


# --- learners, spectra, candidates ----------------------------------------------


def test_boosted_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1200, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.BoostedTrees(rounds=300, patience=50).fit(x[:800], y[:800], x[800:], y[800:])
    assert boosting.rank_auc(y[800:], model.score(x[800:])) > 0.97
    assert model.gains[:2].sum() > 5 * model.gains[2:].sum() and len(model.trees) < 300
    assert all((t[0] < 0).sum() <= 15 for t in model.trees)
    one = boosting.BoostedTrees().fit(x[:50], np.ones(50), x[50:60], np.ones(10))
    assert not one.trees and (one.score(x[:3]) > 0.99).all()


def test_out_of_fold_scores(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 3))
    rows = [(i, float(a), float(b), float(c), int(a + 0.3 * rng.normal() > 0)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y int")
    scores, tests, gains = ln.boosted_oof(df, ["a", "b", "c"], "y", "id", df.select("id", "a", "b", "c"), rounds=60)
    got = scores.toPandas()
    assert sorted(got.id) == list(range(600)) and set(got.fold) == set(range(5))
    assert boosting.rank_auc(got.y.to_numpy(), got.score.to_numpy()) > 0.95 and tests.count() == 600
    assert gains.orderBy(F.desc("importance")).first().feature == "a"
    few, _, _ = ln.boosted_oof(df, ["a", "b", "c"], "y", "id", rounds=20, most_rows=200)
    assert few.count() == 600  # all are scored, whatever is learned from


def test_trees_from_sums_are_those_from_arrays(spark):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(700, 4)), 2)  # ties within features
    x[::50, 1], x[1::50, 2] = 0.0, 1e300
    y = (x[:, 0] + 0.7 * x[:, 3] + rng.normal(size=700) > 0).astype(float)
    fold, ids, names = rng.integers(0, 4, 700), rng.integers(-(2**60), 2**60, 700), list("abcd")
    frame = pd.DataFrame({"y": y, "fold": fold.astype("int32"), "id": ids, **dict(zip(names, x.T))})
    df = spark.createDataFrame(frame).repartition(3)
    cuts = boosting_sums.feature_cuts(df, names, 255)
    # patience ends some folds within a block of rounds, others go on over blocks
    how = dict(rounds=8, patience=2, leaves=5)
    wide = boosting_sums.learn_folds(df, names, cuts, 4, how, block=3)
    lengths = set()
    for m in range(4):
        out = fold == m
        small = boosting.BoostedTrees(**how).fit(x[~out], y[~out], x[out], y[out], ids[~out], cuts)
        assert len(small.trees) == len(wide[m].trees) and small.start == wide[m].start
        for one, other in zip(small.trees, wide[m].trees):
            assert all((a == b).all() for a, b in zip(one, other))
        assert (small.gains == wide[m].gains).all() and (small.score(x) == wide[m].score(x)).all()
        lengths.add(len(small.trees))
    assert len(lengths) > 1 and max(lengths) > 3


def test_trees_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(i, float(i), 1) for i in range(30)], "id long, a double, y int")
    for rows in (df, df.limit(0)):
        for most in (100, 0 if rows is df else -1):
            scores, _, gains = ln.boosted_oof(rows, ["a"], "y", "id", most_rows=most, draws="key", rounds=3)
            assert scores.filter("score < 0.99").count() == 0 and gains.first().importance == 0


def test_draws_take_their_share_and_do_not_depend_on_place():
    ids = np.arange(20_000, dtype=np.int64) - 10_000
    took = boosting.drawn(ids, 3, 0.85)
    assert 0.84 < took.mean() < 0.86 and (boosting.drawn(ids[::-1], 3, 0.85)[::-1] == took).all()
    assert boosting.drawn(ids, 0, 1.0).all() and (boosting.drawn(ids, 4, 0.85) != took).any()


def test_ridge_is_exact(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3)) * [1, 5, 0.2]
    y = x @ [1, -0.3, 2] + rng.normal(size=80)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double")
    out = ln.ridge_and_forest(df, df, ["a", "b", "c"], "y", "id", trees=5).toPandas().sort_values("id")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
    assert np.allclose(out.ridge, z @ w + y.mean(), atol=0.05)


def test_spectral_features(spark):
    rng = np.random.default_rng(7)
    x = {s: rng.normal(size=(60, 12)) * rng.random(12) for s in ("mix", "pop")}
    df = spark.createDataFrame([(s, [float(a) for a in r]) for s, rows in x.items() for r in rows], "side string, f array<double>")
    for r in geometry.spectral_features(df, "side", "f").collect():
        lam = np.sort(np.maximum(np.linalg.eigvalsh(np.cov(x[r.side].T)), 1e-12))[::-1]
        share = lam / lam.sum()
        want = [-(share * np.log(share + 1e-12)).sum(), lam.sum() ** 2 / (lam**2).sum(), lam.sum() / lam[0], *(share[:k].sum() for k in (1, 5, 10))]
        assert [r[c] for c in ("spec_entropy", "participation", "stable_rank", "top1", "top5", "top10")] == pytest.approx(want)


def test_best_candidate_by_plain_patterns(spark):
    """The longest valid match, the first of equals, else the cleaned text if 10 to 100 long."""
    texts = ["Answer: 4111 1111 1111 1234", "cards 4111111111111 and 4111 1111 1111 1234.", "call +48 601 602 603 or 601602603", "x" * 12, "short", "jane.doe@mailer.net", "[REDACTED] 4111 1111 1111 1234", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for kind, pattern, low, high in (("CREDIT", p.CARD_ALT, 13, 19), ("PHONE", p.PHONE_ALT, 9, 15)):
        cleaned = {r.i: r.c for r in df.select("i", tx.clean_edges(F.col("t")).alias("c")).collect()}
        for r in df.select("i", p.best_candidate(F.col("t"), kind).alias("b")).collect():
            t = cleaned[r.i]
            found = [re.sub(r"^[\s\"'`*_.,;:!?#\[\]{}()<>]+|[\s\"'`*_.,;:!?#\[\]{}()<>]+$", "", m.group()) for m in re.finditer(pattern, t)]
            valid = [m for m in found if low <= len(re.sub(r"\D", "", m)) <= high]
            want = "" if not t or "REDACTED" in t.upper() else max(valid, key=len) if valid else t if 10 <= len(t) <= 100 else ""
            assert r.b == want, (kind, texts[r.i])


@pytest.mark.parametrize("whole", [0, 10**6])
def test_running_sums_and_quantiles(spark, whole, monkeypatch):
    monkeypatch.setattr(ordered, "WHOLE", whole)
    rng = np.random.default_rng(9)
    rows = [(k, float(x)) for k, n in (("a", 500), ("b", 33), ("c", 1), ("d", 2)) for x in np.round(rng.normal(size=n) * 10.0 ** rng.integers(-4, 5, n), 3)]
    rows += [("a", None), ("e", None), ("f", float("inf")), ("f", 1.0), ("f", -float("inf"))]
    df = spark.createDataFrame(rows, "k string, x double")
    shares = {"lo": 0.05, "mid": 0.5, "hi": 0.77, "top": 1.0}
    got = {r.k: r for r in ordered.quantiles(df.filter("k <> 'f'"), ["k"], "x", shares).collect()}
    for k in "abcd":
        x = np.array([v for g, v in rows if g == k and v is not None])
        assert [got[k][n] for n in shares] == pytest.approx([np.quantile(x, q) for q in shares.values()], abs=1e-9)
    assert "e" not in got
    counts = df.groupBy("k", "x").agg(F.count("x").alias("n"))
    for down in (False, True):
        for r in ordered.running_sums(counts, ["k"], "x", ["n"], down).collect():
            known = [v for g, v in rows if g == r.k and v is not None]
            if r.x is not None:
                assert r.run_n == sum(v >= r.x if down else v <= r.x for v in known)
            assert r.all_n == len(known)


def test_best_or_default(spark):
    rows = [(1, "EMAIL", "b", 2.0), (1, "EMAIL", "a", 2.0), (1, "EMAIL", "c", 1.0), (1, "PHONE", "x", -5.0), (2, "CREDIT", "y", 0.5)]
    scored = spark.createDataFrame(rows, "id int, pii_type string, cand string, score double")
    out = {(r.id, r.pii_type): r.pred for r in op.best_or_default(scored, spark.createDataFrame([(1,), (2,)], "id int"), "id", "none").collect()}
    assert out == {(i, k): {(1, "EMAIL"): "a", (2, "CREDIT"): "y"}.get((i, k), "none") for i in (1, 2) for k in ("EMAIL", "CREDIT", "PHONE")}


@pytest.mark.parametrize("kind", ["times", "far", "narrow", "ties"])
def test_slots_follow_the_data(spark, kind, monkeypatch):
    monkeypatch.setattr(ordered, "WHOLE", 1000)
    n = 100_000
    value = {"times": F.lit(1.7e9) + F.rand(1) * 30 * 86400, "far": F.lit(1e12) + F.col("id"), "narrow": F.lit(-5.0) + F.rand(2) / 100, "ties": F.floor(F.rand(3) * 200).cast("double")}[kind]
    df = spark.range(n).select("id", value.alias("x")).persist()
    cuts = ordered.splitters(df, "x")
    sizes = [r["count"] for r in ordered.slotted(df, "x", "s", cuts).groupBy("s").count().collect()]
    assert len(sizes) >= 64 and max(sizes) <= 4 * n / len(sizes)
    order = ordered.slotted(df, "x", "s", cuts).groupBy("s").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("s").collect()
    assert all(a.hi < b.lo for a, b in zip(order, order[1:]))
    known = np.sort([r.x for r in df.select("x").collect()])
    shares = {"a": 0.001, "b": 0.05, "c": 0.5, "d": 0.9999}
    got = ordered.quantiles(df.withColumn("k", F.lit(None).cast("string")), ["k"], "x", shares).first()
    assert [got[c] for c in shares] == pytest.approx([np.quantile(known, q) for q in shares.values()], rel=1e-12)
    assert tuple(ordered.quantiles(df, [], "x", {"m": 0.5}).first()) == (pytest.approx(np.quantile(known, 0.5), rel=1e-12),)
    placed = ordered.positions(df.withColumn("k", F.lit(1)), ["k"], "x", "p").select("x", "p").orderBy("p").collect()
    assert [r.p for r in placed] == list(range(n)) and all(a.x <= b.x for a, b in zip(placed, placed[1:]))
    df.unpersist()


def test_slots_of_odd_values(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (-float("inf"),), (0.0,), (-0.0,), (1.0,), (1.0,)]
    df = spark.createDataFrame(rows, "x double")
    for frame in (df, df.filter("x is null or isnan(x)"), df.limit(0)):
        at = ordered.slotted(frame, "x", "s", ordered.splitters(frame, "x")).collect()
        top = max((r.s for r in at if r.x is not None and r.x == r.x), default=-1)
        assert all((r.s == -1) == (r.x is None) for r in at) and all(r.s > top for r in at if r.x is not None and r.x != r.x)


@pytest.mark.parametrize("head", [0, 7, 10**6])
def test_words_looked_up_where_they_lie(spark, head):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.union(spark.createDataFrame([(1, "the the word"), (1, "the the word"), (None, "of é"), (9000, ""), (9001, None), (9002, " ?! ")], docs.schema)).persist()
    words = tx.words(F.col("text"))
    want = {}
    for r in tk.unigram_tokens(docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text"))).distinct(), words).collect():
        want.setdefault(tuple(r.doc_id), {})[r.pos] = r.word
    counts = {r.word: r.n for r in docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    rank = {w: 1 + sum(m > n for m in counts.values()) for w, n in counts.items()}
    texts = {(r.doc_id, r.h): r.w for r in docs.select("doc_id", F.xxhash64("text").alias("h"), words.alias("w")).collect() if r.w}
    got = tk.unigram_arrays(docs, words, head_words=head).collect()
    assert len(got) == docs.filter(F.size(words) > 0).count()
    plain = lambda w: [(round(math.log(counts[x] / total), 9), round(-counts[x] / total * math.log(counts[x] / total), 9), rank[x]) for x in w]
    found = sorted(str((r.doc_id, [(round(a, 9), round(b, 9), c) for a, b, c in zip(r.logp, r.entropy, r["rank"])])) for r in got)
    assert found == sorted(str((r.doc_id, plain(r.w))) for r in docs.select("doc_id", words.alias("w")).collect() if r.w)
    assert tk.unigram_arrays(docs.limit(0), words, head_words=head).count() == 0 and len(texts) == len(want)


def test_covariance_of_wide_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 1024)) * rng.random(1024) + 100
    rows = [("a" if i % 3 else None, v.tolist()) for i, v in enumerate(x)] + [("a", None), ("a", [])]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(40)
    got = {}
    for r in geometry.covariance_blocks(df, "g", "v").collect():
        got.setdefault(r.g, {})[r["first"]] = r
    for g, mine in (("a", x[np.arange(600) % 3 != 0]), (None, x[::3])):
        blocks = [np.reshape(got[g][f].block, (-1, 1024)) for f in sorted(got[g])]
        assert np.allclose(np.concatenate(blocks) / (len(mine) - 1), np.cov(mine.T), rtol=1e-9, atol=1e-12) and got[g][0].n == len(mine)
        assert np.allclose(got[g][0].mean, mine.mean(axis=0))
    found = {r.g: r for r in geometry.spectral_features(df, "g", "v").collect()}
    want = geometry.spectrum(np.linalg.eigvalsh(np.cov(x[::3].T)))
    assert all(abs(found[None][k] - w) < 1e-8 for k, w in want.items())


def test_a_cache_is_read_only_when_whole(spark, tmp_path):
    path, made = f"{tmp_path}/c", []
    make = lambda n: lambda: (made.append(n), spark.range(n))[1]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "part-0.parquet").write_bytes(b"half")  # what a broken job left
    assert tables.read_or_make(spark, path, make(3)).count() == 3
    assert tables.read_or_make(spark, path, make(4)).count() == 3 and made == [3]

    def slow():
        # another writer is done while this one still writes
        tables.read_or_make(spark, f"{tmp_path}/d", make(5))
        return spark.range(6)

    assert tables.read_or_make(spark, f"{tmp_path}/d", slow).count() == 5
    with pytest.raises(Exception, match="broken"):
        tables.read_or_make(spark, f"{tmp_path}/e", lambda: spark.range(3).select(F.raise_error(F.lit("broken"))))
    assert tables.read_or_make(spark, f"{tmp_path}/e", make(2)).count() == 2
    assert sorted(f.name for f in tmp_path.iterdir()) == ["c", "d", "e"]
