"""Weighted Lloyd rounds, importance resampling and licence scans against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import importance, licences, lloyd, words
from weftline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def odd_texts(n=300, seed=1):
    rng = random.Random(seed)
    parts = ["a", "B", "é", "中", "_", " ", "\n", "9", "zz", "X", "日本語", "-", "word", "0" * 40, "ü" * 30]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 200))) for _ in range(n)] + [None, "", "  ", "a" * 5000 + " b c", "é" * 70000]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rel = con.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, want))


# --- words ---------------------------------------------------------------------


@pytest.mark.parametrize("most", [1 << 22, 300, 7])
def test_runs_of_words_and_their_checksums(most):
    texts = odd_texts()
    got = {i: [] for i in range(len(texts))}
    for piece in words.pieces(pa.array(texts), 2, most):
        for row, crc in words.run_checksums(piece, 3):
            for r, c in zip(row.tolist(), crc.tolist()):
                got[r].append(c)
    for i, text in enumerate(texts):
        w = plain_words(text)
        assert sorted(got[i]) == sorted(zlib.crc32(b" ".join(w[j : j + n])) for n in (1, 2, 3) for j in range(len(w) - n + 1))


def test_places_of_words_in_pieces():
    texts = odd_texts(50)
    for most in (1 << 22, 64):
        got = {}
        for piece in words.pieces(pa.array(texts), 2, most):
            for s, n, r, p in zip(piece.start.tolist(), piece.length.tolist(), piece.row.tolist(), piece.place.tolist()):
                word = bytes(piece.low[s : s + n])
                assert got.setdefault((r, p), word) == word
        assert got == {(i, p): w for i, t in enumerate(texts) for p, w in enumerate(plain_words(t))}


# --- importance resampling -------------------------------------------------------


def brute_importance(docs, target, percent=5, least=20, seed=42, buckets=10_000):
    def features(text):
        w = plain_words(text)
        return [zlib.crc32(b" ".join(w[j : j + n])) % buckets for n in (1, 2, 3) for j in range(len(w) - n + 1)], len(w)

    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for b in features(text)[0]:
                held[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f, n = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= least])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0], *r[1:3]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: percent * len(order) // 100])}
    return sorted((str((*r[:4], rank.get(id(r)))) for r in rows))


def test_importance_on_awkward_rows(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma", "déjà", "x1"]) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(500, docs[0][1]), (7, docs[7][1]), (7, docs[7][1]), (600, None), (601, ""), (602, "?!"), (None, "one two " * 15)]
    target = ["alpha beta gamma", None, "", "x1 x1 x1"]
    df = spark.createDataFrame([(t, i, "z", 1) for i, t in docs], "text string, doc_id bigint, score string, weight int")
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 50, 100):
        got = importance.importance(df, tf, percent=percent)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(str(tuple(r)) for r in got.collect()) == brute_importance(docs, target, percent)
    assert importance.importance(df.limit(0), tf).count() == 0
    assert importance.importance(df, tf.limit(0)).count() == len(docs)
    drawn = importance.resample(df.filter("doc_id <> 7"), tf, percent=50)
    assert drawn.columns == df.columns and drawn.count() == 50 * df.filter("doc_id <> 7 and size(split(text, ' ')) >= 20").count() // 100


def test_draw_with_ties(spark):
    df = spark.createDataFrame([(i, 5 if i % 3 else 9, i != 4) for i in range(40)], "doc_id bigint, score bigint, eligible boolean")
    got = {r.doc_id: r["rank"] for r in importance.draw(df, 20).collect()}
    order = sorted((i for i in range(40) if i != 4), key=lambda i: (-(5 if i % 3 else 9), i))
    assert {i: r for i, r in got.items() if r} == {i: k + 1 for k, i in enumerate(order[:20])} and len(got) == 40


# --- weighted Lloyd rounds -------------------------------------------------------


def brute_lloyd(rows, clusters, rounds, width, seed=2):
    good = [(i, v) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in good]
    centroids = [v for _, v in sorted(q, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in q]
    for _ in range(rounds):
        at = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, a) in zip(q, at) if a == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    total = {}
    for d, k in at:
        total[k] = total.get(k, 0) + d
    name = lambda k: hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()
    return sorted(str((i, k, d, total[k], sum(total.values()), name(k))) for (i, _), (d, k) in zip(q, at))


@pytest.mark.parametrize("scale", [1.0, 4e5])
def test_lloyd_on_awkward_rows(spark, scale):
    rng = random.Random(5)
    rows = [(i, [scale * rng.gauss(0, 1) / 4 for _ in range(4)]) for i in range(90)]
    rows += [(200 + i, rows[0][1]) for i in range(60)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (300, [0.0] * 4), (301, [-0.0] * 4)]
    rows += [(400, None), (401, []), (402, [1.0] * 3), (403, [1.0, None, 1.0, 1.0]), (404, [math.nan, 0.0, 0.0, 0.0]), (405, [math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(1, v, i, "x") for i, v in rows], "cluster int, embedding array<double>, vec_id bigint, distance string")
    got = lloyd.cluster(df, clusters=7, rounds=3, width=4)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_lloyd(rows, 7, 3, 4)
    few = lloyd.cluster(df.filter("vec_id in (1, 2, 403)"), clusters=7, rounds=2, width=4)
    assert sorted(str(tuple(r)) for r in few.collect()) == brute_lloyd([r for r in rows if r[0] in (1, 2, 403)], 7, 2, 4)
    empty = lloyd.cluster(df.limit(0), width=4)
    assert empty.columns == got.columns and empty.count() == 0


def test_lloyd_reads_each_different_vector_once(spark):
    df = spark.createDataFrame([(i, [float(i % 3)] * 4) for i in range(600)], "vec_id bigint, embedding array<double>")
    kept = df.select(lloyd.quantised(df.embedding).alias("q"))
    assert kept.groupBy("q").count().count() == 3
    assert sorted(str(tuple(r)) for r in lloyd.cluster(df, clusters=2, rounds=2, width=4).collect()) == brute_lloyd([(i, [float(i % 3)] * 4) for i in range(600)], 2, 2, 4)


def test_lloyd_sums_beyond_doubles():
    x = np.array([[1 << 26, -3], [1 << 26, 5]])
    weight = np.array([1 << 30, 3])
    assert lloyd._sums(x, weight, np.array([0, 0]), 2).tolist() == [[(1 << 26) * ((1 << 30) + 3), -3 * (1 << 30) + 15], [0, 0]]
    at, d = lloyd.nearest(np.array([[lloyd.MOST - 1, 0]]), np.array([[1 - lloyd.MOST, 1]]))
    assert (at.tolist(), d.tolist()) == ([0], [(2 * lloyd.MOST - 2) ** 2 + 1])


# --- licences --------------------------------------------------------------------


def brute_licences(texts):
    """Every definition of the module's docstring, place by place, without an index."""
    split = lambda t: [w.decode() for w in plain_words(t)]
    files = [split(t) for t in texts]
    df = {}
    for f in files:
        for w in set(f):
            df[w] = df.get(w, 0) + 1
    idf = lambda w: math.log((len(files) + 1) / (df.get(w, 0) + 1))
    spots = lambda f, p: [i for i in range(len(f) - len(p) + 1) if f[i : i + len(p)] == p]
    slack, out = licences.SLACK, []
    for f in files:
        base = [(label, i) for phrase, label in licences.BASE.items() for i in spots(f, split(phrase))]
        labels, scores = {b for b, _ in base}, [1.0] if base else [0.0]
        for label, text, phrases in licences.TEMPLATES:
            body = split(text)
            if sum(w in f for w in body) < licences.COVER * len(body) - 1e-9:
                continue
            rare = sorted(set(body) & set(f), key=lambda w: (-idf(w), w))[: licences.RARE]
            votes = {w: {i - q for i, x in enumerate(f) if x == w for q, y in enumerate(body) if y == w} for w in rare}
            for o in set().union(*votes.values()):
                if 2 * sum(any(abs(v - o) <= slack for v in votes[w]) for w in rare) < len(rare):
                    continue
                if not all(any(o - slack <= i <= o + len(body) + slack - len(split(p)) for i in spots(f, split(p))) for p in phrases):
                    continue
                near = lambda q: any(0 <= o + q + d < len(f) and f[o + q + d] == body[q] for d in range(-slack, slack + 1))  # noqa: B023, E731
                cover = sum(near(q) for q in range(len(body))) / len(body)
                if cover >= licences.COVER:
                    labels.add(label)
                    scores.append(cover)
        at = [i for _, i in base]
        out.append((len(f), len(base), min(at) if at else None, max(at) if at else None, ",".join(sorted({b for b, _ in base})), ",".join(sorted(labels)), round(max(scores), 9)))
    return out


def licence_texts():
    rng = random.Random(7)
    some = ["lorem", "license", "the", "and", "of", "public", "general", "mit", "Version", "2", "0", "copyright", "déjà"]
    noise = lambda n: " ".join(rng.choice(some) for _ in range(n))
    texts = [None, "", " ?! ", "MIT License", "mit\nLICENSE, apache-license; general public license general public license", "the mit  license mit", noise(400)]
    for _, text, _ in licences.TEMPLATES:
        w = text.split()
        texts += [text, noise(30) + "\n" + text.upper() + "\n" + noise(30)]
        texts.append(" ".join(x for x in w if rng.random() > 0.1))  # words lost
        texts.append(" ".join(x if rng.random() > 0.25 else "changed" for x in w))  # words changed
        texts.append(" ".join([*w[: len(w) // 2], "Jane", "Doe", "2020", *w[len(w) // 2 :]]))  # a name put in
        texts.append(" ".join(rng.sample(w, len(w))))  # the words in another order
        texts.append(" ".join(w[: len(w) // 2]))  # the first half
    texts.append("\n\n".join(t for _, t, _ in licences.TEMPLATES) * 2)
    return texts + texts[8:12]


@pytest.mark.parametrize("most", [None, 200])
def test_licences_against_brute_force(spark, most, monkeypatch):
    if most:
        cut = words.pieces.__defaults__
        monkeypatch.setattr(words.pieces, "__defaults__", (0, most))
        assert cut
    texts = licence_texts()
    want = brute_licences(texts)
    index = licences.build()
    if most:  # long texts in pieces, here in this process
        finder = licences.Finder(index.vocabulary)
        row, place, word, n = licences._hits(pa.array(texts), finder)
        assert n.tolist() == [w[0] for w in want]
        assert [(r, p, index.vocabulary[w]) for r, p, w in zip(row.tolist(), place.tolist(), word.tolist())] == [
            (i, p, w.decode()) for i, t in enumerate(texts) for p, w in enumerate(plain_words(t)) if w.decode() in set(index.vocabulary)
        ]
        return
    df = spark.createDataFrame([("x", t, i, 0.5) for i, t in enumerate(texts)], "labels string, text string, doc_id bigint, score double")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    assert [(*tuple(got[i])[1:7], round(got[i].score, 9)) for i in range(len(texts))] == [(*w[:4], w[4], w[5], w[6]) for w in want]
    assert sum(w[5] != "" for w in want) > 60 and any(0.7 <= w[6] < 1 for w in want)
    whole = {label for label, *_ in licences.TEMPLATES}
    assert whole <= set(want[-5][5].split(","))
    assert licences.scan(df.limit(0)).count() == 0


def test_licences_are_not_seen_in_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("not contains(lower(text), 'licen')")
    assert licences.scan(docs).filter("labels <> '' or score > 0").count() == 0


# --- earlier operators: bounds and nulls -------------------------------------------


@pytest.mark.parametrize("letters", [10, 40, 300])
def test_languages_are_learned_from_words_of_any_length(letters):
    import public_tokenizers

    from weftline.llm import langid

    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(0)
    word = lambda a: "".join(rng.choice(a) for _ in range(letters))
    two = ("abcdefghijklm", "nopqrstuvwxyz")
    train = [(str(k), " ".join(word(a) for _ in range(8))) for k, a in enumerate(two) for _ in range(10)]
    langs, p = langid.learn(train, pieces)
    got, _ = langid.Scorer(langs, p, pieces).predict([word(two[i % 2]) for i in range(40)])
    assert got == [str(i % 2) for i in range(40)]


def test_long_words_give_what_arrays_give(monkeypatch):
    from weftline.llm import langid

    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abab", "c"]
    lattice = langid.Lattice(pieces)
    rng = np.random.default_rng(0)
    p = rng.random((len(pieces) + 2, 3)) + 0.01
    p[lattice.unknown], p[lattice.none] = langid.FLOOR, 0.0
    words_ = sorted({"▁" + "".join(rng.choice(list("abcd"), 12)) for _ in range(20)})
    counts = rng.integers(0, 3, (len(words_), 3)).astype(float)
    used, logs = langid._expected(lattice, p, words_, counts), langid.word_log_probabilities(lattice, p, words_)
    monkeypatch.setattr(langid, "LONGEST", 3)
    assert np.allclose(langid.word_log_probabilities(lattice, p, words_), logs)
    assert np.allclose(langid._expected(lattice, p, words_, counts)[: len(pieces)], used[: len(pieces)])


def test_labelled_rows_to_learn_from_are_bounded(spark):
    from weftline.llm import gam

    measured = spark.createDataFrame([(i if i > 400 else 3, [float(i)] * len(gam.FEATURES)) for i in range(500)], "doc_id bigint, x array<double>")
    labels = spark.createDataFrame([(3, i % 2) for i in range(50)] + [(i, 1) for i in range(401, 500)], "doc_id bigint, quality int")
    x, y = gam.training_rows(measured, labels, 100)
    assert len(x) == len(y) <= 100
    x, y = gam.training_rows(measured.filter("doc_id > 400"), labels, 1000)
    assert len(x) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(401, 500))


def test_nulls_are_groups_of_their_own(spark):
    from weftline.llm import hilbert, mcd

    rows = [(i, "word " * 60, (None, "", "en")[i % 3], "s") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert hilbert.measured(df).select("d0").distinct().count() == 3
    assert sorted(r.d0 for r in hilbert.measured(df).select("d0").distinct().collect())[0] == ""
    assert mcd.word_statistics(df).select("lang").distinct().count() == 3
    kept = mcd.keep_good(df)
    assert kept.columns == df.columns and kept.count() <= 30
