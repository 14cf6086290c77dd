"""The pipeline against its stages' own definitions."""

import re

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from weftline.llm import _shared, byte_bpe, langid, mcd
from weftline.llm.simhash_wide import shingles

SF = "/root/testdata/sf0.001"


def test_quality_rules_broadcast_under_one_long_key(spark):
    """a broadcast table under another key than one long takes a page of tens of MB, and the steps have some fifty."""
    rows = mcd._judged(mcd.word_statistics(spark.read.parquet(f"{SF}/documents.parquet"))).withColumns({f"x{i}": F.rand(i) for i in range(3)})
    pooled = mcd._pools(rows, 40)
    good = rows.join(pooled, ["lang", "source"]).select("pool", *mcd.STATS)
    params = mcd._factored(good.groupBy("pool").agg(F.lit(0).alias("start"), *mcd._moments(list(mcd.STATS))))
    near = mcd._distances(good, params, 1)
    limits = mcd._limits(near, 0.75)
    assert dict(pooled.dtypes)["pool"] == "bigint" and limits.dtypes[0] == ("place", "bigint")
    joined = near.withColumn("place", mcd._place()).join(F.broadcast(limits), "place")
    assert joined.count() == near.count()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"HashedRelationBroadcastMode\(List\((.*?)\),", plan)
    long_keys = [key for key in keys if re.fullmatch(r"input\[\d+, bigint, \w+\]", key)]
    assert len(long_keys) >= 2, keys


def _entries(bpe):
    return sum(len(m) + len(m.old) for m in (bpe._match, bpe._bare, bpe._spaced))


def test_workers_remember_a_bounded_number_of_pieces():
    """what a worker remembered of words and pieces took most of the memory beside the executor's heap."""
    bpe = byte_bpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    before, letters = _entries(bpe), "abcdefghijklmnop"
    word = lambda i: "".join(letters[(i >> (4 * k)) & 15] for k in range(5))
    texts = [" ".join(word(i) for i in range(at, at + 1000)) for at in range(0, 300_000, 1000)]
    first = [bpe.encode(t).tolist() for t in texts[:3]]
    for text in texts[3:]:
        bpe.encode(text)
    assert _entries(bpe) - before <= 310_000  # each word once
    assert [bpe.encode(t).tolist() for t in texts[:3]] == first
    for i in range(50):
        long = word(i) * 2000
        assert bpe.decode(bpe.encode(f"{long} {long}")) == f"{long} {long}"
    assert max(map(len, (*bpe._match, *bpe._bare, *bpe._spaced))) <= byte_bpe.LONGEST


def test_forgetting_words_changes_no_language():
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    langs, p = langid.learn([("en", "the cat and the dog sat on a mat"), ("fr", "le chat et le chien sur un tapis")], pieces)
    words = "the cat le chat and et dog chien 12 mat, tapis sat un on sur a".split()
    texts = [" ".join(words[(i * k) % len(words)] + "x" * (i % 7) for k in range(1, 9)) for i in range(600)] + ["", "1 2", "the " * 5]
    want = langid.Scorer(langs, p, pieces, 1_000_000).predict(texts)
    small = langid.Scorer(langs, p, pieces, 20)
    got = [small.predict([t]) for t in texts]
    assert [g[0][0] for g in got] == want[0] and [g[1][0] for g in got] == want[1]
    assert len(small._index) + len(small._old) <= 2 * (20 + 8)
    assert len(small._scores) == len(small._index)


def test_texts_are_worked_out_in_bounded_groups(monkeypatch):
    monkeypatch.setattr(langid, "MOST_TEXTS", 3)
    monkeypatch.setattr(langid, "MOST_CHARS", 10)
    assert list(langid._together([])) == []
    assert list(langid._together(["a"] * 4 + ["b" * 30, "", "c" * 10])) == [["a"] * 3, ["a"], ["b" * 30], ["", "c" * 10]]


def test_a_worker_keeps_one_model():
    one = _shared.only("one", list)
    assert _shared.only("one", list) is one
    assert _shared.only("two", dict) == {} and list(_shared._model) == ["two"]
    assert _shared.only("one", list) is not one


def similar_firsts(rows):
    """The smallest id of each component of texts with a similarity of 0.8 or more, by comparing all pairs."""
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in root if find(i) == i}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "source_mixture", "token_ids"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF).cache()
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in mcd.quality_rules(docs).filter("kept").collect()}
    told = stages["language_id"](spark, good, SF).cache()
    assert told.columns == docs.columns and told.count() <= good.count()
    single = stages["near_duplicates"](spark, told, SF).cache()
    assert {r.doc_id for r in single.collect()} == similar_firsts(told.collect())
    mixed = stages["source_mixture"](spark, single, SF)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in single.collect()}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, th int, i int, t string, cid int, k int, x0 double, __source string, __c0 int, v int"


def run_on(spark, tmp_path, rows):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def test_run_on_an_empty_table(spark, tmp_path):
    assert run_on(spark, tmp_path, []).count() == 0


def test_run_on_awkward_rows(spark, tmp_path):
    """Nulls everywhere, an id and text twice, a text of very many words, names that clash with the stages' own."""
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text.split()) > 60][:60]
    more = (1, 2, "t", 3, 4, 5.0, "s", 6, 7)
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *more) for r in docs]
    first = rows[0]
    long = " ".join(f"{w} {i % 977}" for i, w in enumerate(" ".join(r.text for r in docs).split() * 4))
    rows += [first, (None, first[1], *first[2:]), (None,) * len(first), (10**6, None, *first[2:]), (10**6 + 1, "", None, None, None, *[None] * 9), (10**6 + 2, long, "en", None, 1, *more), (10**6 + 3, "\u00bd \u00b2 " * 80, "en", "a", 1, *more)]
    out = run_on(spark, tmp_path, rows).collect()
    # what has no words, or no letters, goes; of the same text one row stays, but as often as its source is repeated
    assert out and {r.doc_id for r in out} <= {r[0] for r in rows} - {10**6, 10**6 + 1, 10**6 + 3, None}
