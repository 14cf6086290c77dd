"""Each operator against a brute-force version, a round trip or held-out rows, and on awkward rows."""

import functools
import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weftline.llm import byte_bpe, gam, hilbert, html_text, langid, mcd, rp_forest, simhash, simhash_wide, temperature_mix, token_files

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, fp long, n int, key string, size long, rank int"
CLASH = (1, 2, "x", 3, 4)  # columns named as the operators name theirs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [
        (1, None, "en", "a", *CLASH), (2, "", None, "a", *CLASH), (3, "one", "en", None, *CLASH), (4, "same words here now", "en", "a", *CLASH),
        (4, "same words here now", "en", "a", *CLASH), (5, "same words here now", "fr", "b", *CLASH), (None, "no id at all", "en", "b", *CLASH),
        (6, "long " * 30_000, "en", "b", *CLASH), (7, " \n\t \n", "en", "b", *CLASH), (8, "日本 é 𝒳 1 !! \x1c x", "de", "c", *CLASH),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1 ---------------------------------------------------------------------------


def reference_bpe():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BPE), special_tokens={})


def test_bpe_equals_tiktoken(spark, docs):
    want = reference_bpe()
    out = by_id(byte_bpe.round_trip(docs, BPE, public_tokenizers.PATTERN))
    for r in docs.collect():
        ids = want.encode_ordinary(r.text)
        row = out[r.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_bpe_on_odd_text():
    want, own = reference_bpe(), byte_bpe.load(BPE, public_tokenizers.PATTERN)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "𝒳", "'s", "1", "#", " ", " ", "the", "\r\n", "\x1c"]
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        ids = own.encode(text).tolist()
        assert ids == want.encode_ordinary(text)
        assert own.decode(ids) == text


def test_bpe_spans_and_split_characters():
    own = byte_bpe.load(BPE, public_tokenizers.PATTERN)
    text = "naïve 𝒳𝒴 日本語 ok"
    ids = own.encode(text)
    starts, ends = own.spans(ids, text.encode())
    at = 0
    for token, start, end in zip(ids, starts, ends):
        raw = own.tokens[token]
        first, last = len(text.encode()[:at].decode(errors="ignore")), at + len(raw)
        assert start == first and text.encode()[:last].decode(errors="ignore") <= text[:end]
        at = last
    decoder = byte_bpe.StreamDecoder(own)
    assert "".join(decoder.feed([i]) for i in ids.tolist()) + decoder.feed([], final=True) == text
    assert all(own.read_spelling(own._spell(t)) == t for t in own.tokens)


def test_bpe_tables(spark, awkward, empty):
    encoded = byte_bpe.encode_documents(awkward, BPE, public_tokenizers.PATTERN)
    back = byte_bpe.decode_documents(encoded, BPE, public_tokenizers.PATTERN)
    assert Counter(r.text for r in back.collect()) == Counter(r.text or "" for r in awkward.collect())
    assert byte_bpe.round_trip(awkward, BPE, public_tokenizers.PATTERN).count() == awkward.count()
    assert byte_bpe.round_trip(empty, BPE, public_tokenizers.PATTERN).count() == 0


# 2 ---------------------------------------------------------------------------


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (2, 1), (4, 2)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    cells = spark.range(1 << dims * bits).select(*[(F.shiftright("id", bits * i) % (1 << bits)).alias(f"x{i}") for i in range(dims)])
    path = cells.withColumn("h", hilbert.hilbert_index([F.col(f"x{i}") for i in range(dims)], bits)).orderBy("h").collect()
    assert [r.h for r in path] == list(range(1 << dims * bits))
    assert all(sum(abs(a[i] - b[i]) for i in range(dims)) == 1 for a, b in zip(path, path[1:]))


def test_hilbert_shards(spark, docs, awkward, empty):
    for table in (docs, awkward):
        out = hilbert.hilbert_shards(table).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in table.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want
        sizes = Counter(r.shard for r in out)
        assert max(sizes.values()) - min(sizes[s] for s in range(8)) <= 1
        for s, n in sizes.items():
            assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
        curve = [r.curve for r in sorted(out, key=lambda r: (r.shard, r.slot))]
        assert curve == sorted(curve)
    assert hilbert.hilbert_shards(empty).count() == 0
    ranges = hilbert.shard_ranges(hilbert.hilbert_shards(docs), ["size"]).collect()
    assert sum(r.n_rows for r in ranges) == docs.count()


# 3 ---------------------------------------------------------------------------


def mixed_docs(spark):
    rows = [(i, "x" * 400, "big" if i % 10 else "small") for i in range(2000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_exponent_meets_its_bound(spark):
    totals = spark.createDataFrame([("a", 900, 9), ("b", 90, 9), ("c", 10, 1)], "__source string, tokens long, n_docs long")
    a = temperature_mix.bisect_exponent(totals, 3.0, 1.0)
    assert 90 ** (1 - a) == pytest.approx(3.0, abs=1e-3)
    a = temperature_mix.bisect_exponent(totals, 1e9, 0.7)
    w = np.array([900, 90, 10.0]) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.7 * np.log(3), abs=1e-4)


def test_mix_takes_every_document_and_meets_weights(spark, awkward, empty):
    docs = mixed_docs(spark)
    out = temperature_mix.mix(docs, max_repeats=2.5, entropy_share=1.0).groupBy("doc_id", "source").count().collect()
    assert len(out) == 2000
    copies = {s: sum(r["count"] for r in out if r.source == s) for s in ("big", "small")}
    assert copies["big"] == 1800 and copies["small"] == pytest.approx(500, abs=1)
    half = temperature_mix.mix(docs, max_repeats=2.5, entropy_share=1.0, budget=100_000).groupBy("source").agg(F.sum("__tokens").alias("t")).collect()
    assert sum(r.t for r in half) == pytest.approx(100_000, abs=250)
    assert {r.text for r in temperature_mix.mix(awkward).collect()} == {r.text for r in awkward.collect()}
    assert temperature_mix.mix(empty).count() == 0


def brute_mixture(rows, exponent):
    """Weights and whole and partial repeats of each source, from (source, tokens) of documents; the budget takes each once at least."""
    totals = Counter()
    for source, tokens in rows:
        totals[source] += tokens
    powered = {s: t**exponent for s, t in totals.items()}
    weights = {s: p / sum(powered.values()) for s, p in powered.items()}
    budget = max(totals[s] / weights[s] for s in totals)
    return totals, weights, {s: weights[s] * budget / totals[s] for s in totals}


def test_mix_against_brute_force(spark):
    """Every document's copies, every source's weight, and whole blocks in the order of their turns."""
    i = F.col("doc_id")
    source = F.when(i % 3 == 0, "hot").when(i % 7 == 1, None).otherwise(F.concat(F.lit("s"), i % 4))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("source", source)
    rows = [(r.doc_id, r.source or "", max(1, -(-len((r.text or "").encode()) // 4))) for r in docs.collect()]
    totals = temperature_mix.source_totals(docs)
    exponent = temperature_mix.bisect_exponent(totals, 2.0, 0.97)
    shares, weights, repeats = brute_mixture([r[1:] for r in rows], exponent)
    widest = max(shares.values()) / min(shares.values())
    entropy = -sum(w * np.log(w) for w in weights.values())
    # the least exponent that keeps both bounds: a little less breaks one
    less = {s: t ** (exponent - 2e-5) for s, t in shares.items()}
    lower = [p / sum(less.values()) for p in less.values()]
    assert widest ** (1 - exponent) <= 2.0 + 1e-9 and entropy <= 0.97 * np.log(len(shares)) + 1e-9
    assert exponent == 0 or widest ** (1 - exponent + 2e-5) > 2.0 or -sum(w * np.log(w) for w in lower) > 0.97 * np.log(len(shares))
    out = temperature_mix.mix(docs, block_tokens=2048).collect()
    copies = Counter(r.doc_id for r in out)
    tokens = dict((r[0], r[2]) for r in rows)
    for source in shares:
        ids = [r[0] for r in rows if r[1] == source]
        full = int(np.floor(round(repeats[source], 9)))
        assert {copies[i] for i in ids} <= {full, full + 1} and full >= 1
        spent = sum(copies[i] * tokens[i] for i in ids)
        assert abs(spent - repeats[source] * shares[source]) <= max(tokens[i] for i in ids)
        mine = [r for r in out if (r.source or "") == source and r["__epoch"] == full]
        whole = {}
        for r in out:
            if (r.source or "") == source and r["__epoch"] == 0:
                whole.setdefault(r["__block"], set()).add(r.doc_id)
        # the partial epoch takes the first blocks by turn, all but the last of them whole
        taken = {}
        for r in mine:
            taken.setdefault((r["__turn"], r["__block"]), set()).add(r.doc_id)
        for _, block in sorted(taken)[:-1]:
            assert taken[[k for k in taken if k[1] == block][0]] == whole[block]


def test_mix_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 5, 6, 7), (2, "d", None, 8, 9, 10)], "doc_id long, text string, source string, __source int, __tokens int, __c0 int")
    out = temperature_mix.mix(df)
    assert out.columns == [*df.columns, "___tokens", "__epoch", "__block", "__turn"]
    assert {(r.doc_id, r["__source"], r["__tokens"], r["___tokens"]) for r in out.collect()} == {(1, 5, 6, 2), (2, 8, 9, 1)}


def test_mix_order_is_a_permutation_of_blocks(spark):
    out = temperature_mix.mix(mixed_docs(spark), block_tokens=1000).filter("__epoch = 0 and source = 'big'")
    turns = out.groupBy("__block").agg(F.count_distinct("__turn").alias("n")).collect()
    assert len(turns) > 10 and all(r.n == 1 for r in turns)


# 4 ---------------------------------------------------------------------------


def brute_components(ids, fps, radius=2):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (2**64 - 1)).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def plain_fingerprint(text):
    import xxhash

    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(spark, docs):
    rows = docs.collect()
    fps = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = brute_components([r.doc_id for r in rows], [fps[r.doc_id] for r in rows])
    for r in simhash.near_duplicates(docs).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def clustered_fingerprints():
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(30)}
    return sorted(f - (1 << 64) if f >= 1 << 63 else f for f in fps | {rng.getrandbits(64) for _ in range(50)})


@pytest.mark.parametrize("crowd", [2, 24, 2048])
def test_links_of_clusters(spark, crowd):
    """Dense clusters, chains and strangers; small ``crowd`` sends them the exact way round."""
    fps = clustered_fingerprints()
    want = brute_components(fps, fps)
    edges = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), crowd=crowd)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert {f: found.get(f, f) for f in fps} == want


def test_pivots_find_and_discard_pairs():
    """Of 50 million pairs of strangers few meet, fewer survive; of planted pairs all are found."""
    rng = np.random.default_rng(8)
    fps = rng.integers(-(2**63), 2**63, 10_000)
    flips = np.left_shift(np.int64(1), rng.integers(0, 64, (500, 2)))
    near = fps[:500] ^ flips[:, 0] ^ np.where(rng.random(500) < 0.7, flips[:, 1], 0)
    every = np.unique(np.concatenate([fps, near]))
    table = simhash.pivot_table(every, range(64))
    assert (np.bitwise_count(simhash.PIVOTS[:, None] ^ simhash.PIVOTS)[~np.eye(64, dtype=bool)] == 32).all()
    cuts = simhash.Cuts(np.stack([np.bincount(table[:, p], minlength=65) for p in range(64)]), 256)
    rows, cells = cuts.cells(every)
    order = np.argsort(cells, kind="stable")
    a, b, (met, survived, linked) = simhash.compare(every[rows[order]], cells[order], cuts.more, 2)
    pairs = len(every) * (len(every) - 1) // 2
    assert met < pairs / 20 and survived < met / 5 and linked >= 450
    want = {(min(x, y), max(x, y)) for x, y in zip(fps[:500].tolist(), near.tolist()) if x != y}
    assert set(zip(a.tolist(), b.tolist())) >= want


def test_components_of_hubs_and_chains(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5200)] + [(7000, 7000)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 3000)} | {i: 5000 for i in range(5001, 5201)}


def test_simhash_awkward(spark, awkward, empty):
    out = simhash.near_duplicates(awkward).collect()
    assert len(out) == awkward.count() and simhash.near_duplicates(empty).count() == 0
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out}
    assert got[1] == got[2] == got[7] == ("0" * 16, 1)
    assert got[4][1] == got[5][1] == 4
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "8", "None"]


def test_similar_texts(spark, awkward, empty):
    rng = random.Random(1)
    rows, want = [], set()
    for g in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        want.add(len(rows))
        for copy in range(1 + g % 5):
            new = list(words)
            for _ in range(copy % 4):  # up to three words changed: a similarity of 0.86 or more
                new[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(new)))
    kept = simhash_wide.drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == want
    kept = simhash_wide.drop_similar(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "6", "8", "None"]
    assert simhash_wide.drop_similar(empty).count() == 0


def test_similar_texts_with_clashing_columns(spark):
    columns = "i long, t string, doc_id long, text string, th int, cid int, k int, root int, first int, pivots int, node int, __c0 int, __h int"
    words = " ".join(f"w{i}" for i in range(50))
    rows = [(5, "x", i, t, *range(9)) for i, t in ((3, words), (1, words + " more"), (2, "other words here"), (1, words + " more"))]
    df = spark.createDataFrame(rows, columns)
    kept = simhash_wide.drop_similar(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r.t, r.k) for r in kept.collect()) == [(1, "x", 2), (2, "x", 2)]


def test_pivot_rows_discard_strangers_and_no_pair():
    """Of 4,950 pairs the table keeps all that are similar enough, and few others."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(20)]
    for base in list(sets):
        for share in (0.95, 0.9, 0.85, 0.6):
            keep = rng.random(len(base)) < share
            sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 2**64, int((~keep).sum()), dtype=np.uint64)])))
    table = simhash_wide.PivotTable([simhash_wide.pivot_row(s) for s in sets])
    discarded = 0
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            common = len(np.intersect1d(a, b))
            out = table.apart(np.array([i]), np.array([j]))[0] > simhash_wide.most_apart(len(a), len(b), 0.8)
            assert not (out and common >= 0.8 * (len(a) + len(b) - common))
            discarded += out
    assert discarded > 4700


def test_prefixes_meet_at_the_threshold():
    """Two sets of a similarity of just 0.8 share a shingle of their prefixes in any order, whatever their number."""
    rng = random.Random(11)
    for step in range(300):
        u = rng.randint(1, 40) * 5 if step else 5
        order = rng.sample(range(10**9), u)
        only = set(rng.sample(range(u), u // 5))  # a fifth of the union is in one of them
        a = sorted(v for i, v in enumerate(order) if i not in only or i % 2)
        b = sorted(v for i, v in enumerate(order) if i not in only or not i % 2)
        assert set(a[: simhash_wide.prefix_length(len(a), 0.8)]) & set(b[: simhash_wide.prefix_length(len(b), 0.8)])


def test_similar_variants_equal_brute_force(spark, monkeypatch):
    """Crowds of variants of one text, many of them close to the threshold on either side."""
    rng = random.Random(7)
    rows = []
    for _ in range(3):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for _ in range(150):
            new = list(base)
            for _ in range(rng.randint(3, 6)):
                new[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(new)))
    sets = {i: simhash_wide.shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i in root if find(i) == i}
    assert {r.doc_id for r in simhash_wide.drop_similar(df).collect()} == want
    monkeypatch.setattr(simhash_wide, "_links", functools.partial(simhash_wide._links, block_rows=32))
    assert {r.doc_id for r in simhash_wide.drop_similar(df).collect()} == want


# 5 ---------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark, docs, awkward, empty):
    for table in (docs, awkward):
        texts = {}
        for r in table.collect():
            texts.setdefault(r.doc_id, r.text)
        for r in mcd.quality_rules(table).collect():
            want = plain_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
            assert r.base_failed == failed and not (failed and r.kept)
    assert mcd.quality_rules(empty).count() == 0
    assert mcd.keep_good(docs).columns == docs.columns
    assert mcd.keep_good(docs).count() == mcd.quality_rules(docs).filter("kept").count()


def plain_mcd(x, coverage=0.75, reweight=0.975):
    """Squared distances by a minimum covariance determinant in numpy: exact subsets, many random starts."""
    n, d = x.shape
    h, rng = int(np.ceil(coverage * n)), np.random.default_rng(0)
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + mcd.TINY * np.eye(d)), x - m)
    best = (np.inf, None, None)
    for start in range(30):
        rows = rng.choice(n, min(n, max(d + 2, n // 4)), replace=False)
        for _ in range(100):
            m, c = x[rows].mean(0), np.cov(x[rows].T, bias=True)
            after = np.sort(np.argsort(distance(m, c), kind="stable")[:h])
            if np.array_equal(after, rows):
                break
            rows = after
        det = np.linalg.slogdet(c + mcd.TINY * np.eye(d))[1]
        if det < best[0] - 1e-12:
            best = (det, m, c)
    factor = lambda p: p / mcd.chi_square_share(mcd.chi_square_quantile(p, d), d + 2)
    near = x[distance(best[1], best[2] * factor(coverage)) <= mcd.chi_square_quantile(reweight, d)]
    return distance(near.mean(0), np.cov(near.T, bias=True) * factor(reweight))


def test_estimate_finds_the_least_determinant(spark):
    """Correlated rows with a fifth of others near the long axis: only the covariance tells them."""
    rng = np.random.default_rng(6)
    x = rng.multivariate_normal([0, 0, 0], [[1, 0.95, 0], [0.95, 1, 0], [0, 0, 0.2]], 800)
    x[:160] = rng.multivariate_normal([1.2, -1.2, 0.5], 0.02 * np.eye(3), 160)
    rows = spark.createDataFrame([("p", *map(float, r)) for r in x], "pool string, x0 double, x1 double, x2 double")
    got = mcd._distances(rows, mcd.estimate(rows, 1, 0.75, 0.975), 1).toPandas().d2.to_numpy()
    want = plain_mcd(x)
    limit = mcd.chi_square_quantile(0.99999, 3)
    assert (got[:160] > limit).all() and (got[160:] <= limit).all()
    assert np.mean((got > limit) == (want > limit)) > 0.995 and np.median(np.abs(got / want - 1)) < 0.05


def test_verdicts_equal_a_plain_estimate(spark):
    """The whole table of 10,000 documents, where groups reach the least size."""
    import unicodedata

    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = by_id(mcd.quality_rules(big))
    groups, size = {}, Counter()
    for r in big.collect():
        g = got[r.doc_id]
        key = (r.lang or "", r.source or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        marks = sum(unicodedata.category(c)[0] not in "LN" for w in words for c in w)
        groups.setdefault(key, []).append((r.doc_id, g.n_words, g.word_chars, marks, len(words) - len(set(words)), g.base_failed))
        size[key] += not g.base_failed
    pools = {}
    small = Counter()
    for (lang, source), n in size.items():
        small[lang] += n if n < 40 else 0
    for (lang, source), rows in groups.items():
        pool = (lang, source) if size[lang, source] >= 40 else (lang,) if small[lang] >= 40 else ()
        pools.setdefault(pool, []).extend(r for r in rows if not r[5])
    same = total = 0
    limit = mcd.chi_square_quantile(0.99999, 3)
    for rows in pools.values():
        ids, n, c, m, a = (np.array([r[i] for r in rows], dtype=float) for i in range(5))
        t = [np.exp(np.median(v)) for v in (np.log(c / n), np.log((m + 0.5) / c), np.log((a + 0.5) / n))]
        x = np.log(np.stack([(c + 100 * t[0]) / (n + 100), (m + 100 * t[0] * t[1]) / (c + 100 * t[0]), (a + 100 * t[2]) / (n + 100)], axis=1))
        same += sum((d <= limit) == got[int(i)].kept for i, d in zip(ids, plain_mcd(x)))
        total += len(ids)
    assert total > 8000 and same >= 0.999 * total


def test_keep_good_with_clashing_columns_and_awkward_rows(spark, docs, awkward, empty):
    named = docs.selectExpr("doc_id", "text", "lang", "source", "1 AS th", "2 AS pool", "3 AS x0", "4 AS kept", "5 AS __id", "6 AS start", "7 AS bin", "8 AS __c1")
    kept = mcd.keep_good(named)
    assert kept.columns == named.columns and kept.count() == mcd.keep_good(docs).count()
    assert mcd.keep_good(empty).columns == empty.columns and mcd.keep_good(empty).count() == 0
    assert mcd.keep_good(awkward).count() == 0  # none has fifty words that don't repeat
    assert mcd.quality_rules(awkward).count() == awkward.count()


def test_outliers_agree_with_labels(spark):
    big = "/root/testdata/sf0.01"
    out = mcd.quality_rules(spark.read.parquet(f"{big}/documents.parquet")).filter("not base_failed")
    joined = out.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id")
    kept = {(r.quality, r.kept): r["count"] for r in joined.groupBy("quality", "kept").count().collect()}
    assert kept[(1, True)] >= 0.98 * (kept[(1, True)] + kept.get((1, False), 0))
    assert kept.get((0, False), 0) >= 0.9 * (kept.get((0, False), 0) + kept.get((0, True), 0))


def test_chi_square():
    assert mcd.chi_square_share(9.487729, 4) == pytest.approx(0.95, abs=1e-6)
    assert mcd.chi_square_quantile(0.95, 4) == pytest.approx(9.487729, abs=1e-5)
    assert mcd.chi_square_share(7.814728, 3) == pytest.approx(0.95, abs=1e-6)


# 6 ---------------------------------------------------------------------------


def test_quality_model(spark, docs, awkward, empty):
    mid = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{mid}/labels.parquet")
    out = gam.score_quality(spark.read.parquet(f"{mid}/documents.parquet"), labels)
    held = out.filter("held_out").join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.collect())
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.collect())
    scored = gam.score_quality(awkward, labels)
    assert scored.count() == awkward.count()
    assert gam.score_quality(empty, labels).count() == 0
    assert {r.score for r in gam.score_quality(awkward, labels.limit(0)).collect()} == {0.5}


def test_pair_tables_learn_what_single_ones_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.AdditiveModel(pairs=2).fit(x, y)
    assert (1, 0) in model.pairs
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95


def test_scores_are_sums_of_table_entries(spark):
    """Each score anew from the model's tables, by bisection and one addition at a time; the model anew from the same rows."""
    import bisect
    import math

    mid = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{mid}/documents.parquet"), spark.read.parquet(f"{mid}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    learned = sorted((r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1)
    model = gam.AdditiveModel().fit(np.array([gam.features(texts[i]) for i, _ in learned]), np.array([q for _, q in learned], dtype=float))
    for r in gam.score_quality(docs, labels).collect():
        x = gam.features(texts[r.doc_id])
        at = [bisect.bisect_right(list(c), v) for c, v in zip(model.cuts, x)]
        raw = model.intercept
        for table, k in zip(model.tables, at):
            raw += float(table[k])
        for (i, j), table in zip(model.pairs, model.pair_tables):
            raw += float(table[at[i]][at[j]])
        assert r.score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9)


def test_quality_with_clashing_columns(spark):
    mid = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{mid}/labels.parquet").selectExpr("*", "1 AS x", "2 AS y", "3 AS __id")
    docs = spark.createDataFrame([(1, "a b c", 1.0, 2, 3), (None, None, 1.0, 2, 3)], "doc_id long, text string, x double, y int, score int")
    out = {r.doc_id: r for r in gam.score_quality(docs, labels).collect()}
    assert set(out) == {1, None} and out[None].held_out is False


# 7 ---------------------------------------------------------------------------


def test_html(spark, empty):
    page = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="ad">Buy, buy, buy this long advert that goes on and on, and on</div><article><h1>Head &amp; more</h1><p><b>First,  para\n with <a href=x>link</a>.<br><p>Second &eacute; &#233;, text.
    <form>Name <input></form><aside>Side</aside></article><div id="comments"><p>I, a reader, disagree with this, at length, and with commas</div><footer>&copy; me</footer></body>"""
    assert html_text.main_text(page) == "Head & more\nFirst, para with link.\nSecond é é, text."
    plain = "<div><p>One, two, three, and a good many words more to be read here.</p><p>And again, some more words, for good measure.</p></div><div class=menu><a>x</a></div>"
    assert html_text.main_text(plain).count("\n") == 1
    for odd in (None, "", "<", "<p", "<p>a<p>b</div></b>", "<!-- never closed <p>x", "just text", "<script>never closed", '<a href="x>y', "<p>" * 3000):
        assert isinstance(html_text.main_text(odd), str)
    rows = spark.createDataFrame([(1, "u", page, 1), (2, None, None, 1), (2, None, None, 1)], "page_id long, url string, html string, text int")
    out = html_text.extract(rows).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, len(html_text.main_text(page))]
    assert html_text.extract(rows.limit(0)).count() == 0


RUNNING = "<p>One, two, three, and a good many words more to be read here, all of it running text.</p><p>And again, some more words, for good measure.</p>"
READ = html_text.main_text(RUNNING)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="content no-sidebar">%s</div><div class="sidebar"><p>Side, side, side text.</p></div>', "%s"),
        ('<div class="page-with-side-menu">%s</div>', "%s"),
        ('<div id=x><p class="lead share">Lead, first.</p>%s</div>', "Lead, first.\n%s"),
        ("<div class=title><h1>The Head</h1></div><div class=body>%s</div><div class=end><h2>Last</h2><p>Short end.</p></div>", "The Head\n%s\nLast\nShort end."),
        ("\u0130<SCRIPT>x</SCRIPT><article>%s</article>", "%s"),
        ("<article>%s<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p></article>", "%s\nLet x=2 be."),
        ("<article>%s<p>a <svg><title>t</title></svg>b <button>Press</button>c.</p></article>", "%s\na b c."),
        ('<div class="sidebar-right">%s</div><div class="widget"><p>Small.</p></div>', "%s"),
        ("<nav><p>x</nav><header><h1>Site</h1></header>%s<footer>y", "%s"),
        ('%s<div class="comments"><p>I, a reader, with more to say than the article has, and much more than it should have, don\'t agree with this at all, never, and never.</p></div>', "%s"),
        ("%s<p>cut <a href=", "%s\ncut"),
    ],
)
def test_html_names_and_places(page, want):
    assert html_text.main_text(page % RUNNING) == want % READ


@pytest.mark.parametrize("page", ["<div><p>" * 50_000, "<div>" * 100_000 + "</p>" * 100_000, "<ul>" + "<div>" * 3000 + "<li></li>" * 30_000, "<span hidden>" * 100_000, '<div class="side">x' * 50_000, "<a" * 100_000, '<a "' * 50_000, "<script>" * 100_000])
def test_html_in_linear_time(page):
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 3


def test_html_table(spark, empty):
    """Null ids and clashing columns."""
    rows = spark.createDataFrame([(None, None, RUNNING, "a", 1, 2), (1, "u", None, None, 3, 4)], "page_id long, url string, html string, text string, n_chars int, n int")
    out = html_text.extract(rows)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert {(r.page_id, r.text, r.n_chars) for r in out.collect()} == {(None, READ, len(READ)), (1, "", 0)}


def test_pages_give_their_articles(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = by_id(html_text.extract(pages), "page_id")
    for r in pages.collect():
        body = re.search(r"(?s)<article>(.*)</article>", r.html).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", body)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)


# 8 ---------------------------------------------------------------------------


def brute_links(x, least=0.95):
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= least
    np.fill_diagonal(close, False)
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(close, label[None, :], len(x)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return close, label
        label = new


def vector_table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>")


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(3000, 32))
    near = base[:400] + rng.normal(scale=0.18, size=(400, 32)) * np.abs(base[:400]).mean()
    dense = base[0] + rng.normal(scale=0.01, size=(150, 32))
    # pairs spread over the cosines from just below the threshold on
    away = rng.normal(size=(600, 32))
    away -= (away * base[600:1200]).sum(1, keepdims=True) / (base[600:1200] ** 2).sum(1, keepdims=True) * base[600:1200]
    c = rng.uniform(0.94, 0.98, (600, 1))
    away = c * base[600:1200] + np.sqrt(1 - c * c) * away / np.linalg.norm(away, axis=1, keepdims=True) * np.linalg.norm(base[600:1200], axis=1, keepdims=True)
    x = np.concatenate([base, near, dense, away, base[:5], base[:5]]).astype(np.float32)
    return x, *brute_links(x.astype(float))


@pytest.mark.parametrize("how", [{"leaf_rows": 32, "block_rows": 64}, {"leaf_rows": 128, "block_rows": 64, "sample_rows": 64}])
def test_forest_recall_and_exactness(spark, vectors, how):
    """Trees of depth 7, or cut short and split level by level; links at each distance from the threshold, and whole components."""
    x, close, label = vectors
    out = sorted(rp_forest.link_vectors(vector_table(spark, x), **how).collect())
    got = np.array([r.n_links for r in out])
    assert (got <= close.sum(1)).all()
    assert got.sum() >= 0.99 * close.sum()
    alone = np.flatnonzero(close[3550:4150].sum(1) == 1) + 3550  # linked with one other, at 0.95 to 0.98
    assert len(alone) > 300 and got[alone].sum() >= 0.95 * len(alone)
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in out)
    found = np.array([r.component_id for r in out])
    assert np.mean(found == label) > 0.99


def test_forest_equals_brute_force_in_one_leaf(spark, vectors, monkeypatch):
    """One leaf for all, compared block against block."""
    x, close, label = vectors
    monkeypatch.setattr(rp_forest, "_split_further", lambda routed, *_: routed)
    out = sorted(rp_forest.link_vectors(vector_table(spark, x), leaf_rows=10_000, block_rows=500).collect())
    assert [r.n_links for r in out] == close.sum(1).tolist() and [r.component_id for r in out] == label.tolist()


def test_forest_on_odd_vectors(spark):
    """Lengths of their own, components whose squares overflow, repeated and null ids, one very long vector, clashing columns."""
    long = [float(i % 7) for i in range(50_000)]
    rows = [
        (1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1.0, 0.0, 0.01]), (4, [1.0, 0.0, 0.0]), (5, [1.0, -1.0]), (6, long), (7, [2 * v for v in long]),
        (8, [5e-324, 5e-324]), (9, [0.0, 1.0]), (9, [1.0, 0.0]), (None, [1.0, 1.0]), (None, [-3.0, 1.0]),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "vec_id long, embedding array<double>, v int, cid int, leaf int, n int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in rp_forest.link_vectors(df).collect()]
    # 8 has the direction of the first two, and so has one without an id
    want = [(1, 3, 1), (2, 3, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 1, 6), (7, 1, 6), (8, 3, 1), (9, 0, 9), (9, 0, 9), (None, 3, 1), (None, 0, None)]
    assert Counter(got) == Counter(want)


def test_forest_awkward(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0]), (10, [1.0, 0.0, 0.0]), (11, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.link_vectors(df).collect()}
    assert out[6] == (2, 6) and out[7] == (2, 6) and out[8] == (2, 6)
    assert all(out[i] == (0, i) for i in (1, 2, 3, 4, 5, 9, 10, 11))
    assert rp_forest.link_vectors(df.limit(0)).count() == 0


# 9 ---------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ["▁a", "▁ab", "b", "ab", "▁", "a"]
    lattice = langid.Lattice(pieces)
    p = np.array([[0.1], [0.2], [0.3], [0.05], [0.15], [0.2], [langid.FLOOR], [0.0]])
    known = dict(zip(pieces, p[:, 0]))

    def total(word):
        if not word:
            return 1.0
        return sum((known.get(word[:i]) or (langid.FLOOR if i == 1 else 0.0)) * total(word[i:]) for i in range(1, len(word) + 1))

    for word in ("▁ab", "▁aab", "▁bab", "▁xa"):
        assert np.exp(langid.word_log_probabilities(lattice, p, [word]))[0, 0] == pytest.approx(total(word))


def test_keep_known_with_clashing_columns_and_awkward_rows(spark, awkward, empty):
    mid = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang", "1 AS th", "2 AS held_out", "3 AS lang_pred", "4 AS score", "5 AS __id", "6 AS __c1")
    kept = langid.keep_known(mid, PIECES)
    assert kept.columns == mid.columns and kept.count() >= 0.99 * mid.count()
    assert langid.keep_known(empty, PIECES).count() == 0
    assert {r.doc_id for r in langid.keep_known(awkward, PIECES).collect()} <= {3, 4, 5, None, 6, 8}
    assert all(r.held_out is not None for r in langid.identify(awkward, PIECES).collect())


def test_long_words_and_numerals():
    pieces = langid.vocabulary(PIECES)
    assert max(map(len, pieces)) == langid.LONGEST_PIECE
    langs, p = langid.learn([("en", "the cat and the dog"), ("fr", "le chat et le chien")], pieces)
    lattice, rng = langid.Lattice(pieces), random.Random(2)
    words = [langid.START + "".join(rng.choices("thecaning", k=rng.randint(1, langid.LONGEST - 1))) for _ in range(40)]
    each = np.array([langid._long_word(lattice, np.log(np.maximum(p, 1e-300)), w) for w in words])
    assert np.allclose(langid.word_log_probabilities(lattice, p, words), each)
    scorer = langid.Scorer(langs, p, pieces)
    assert scorer.predict(["\xbd \xb2 \u2460", "12 34", "\xbd the \xb2"])[0] == ["und", "und", "en"]
    assert scorer.predict(["thecat" * 5000])[0] == ["en"]
    assert langid.words_of("a\xbdb C3d") == ["▁a", "▁b", "▁c", "▁d"]


def test_language_accuracy_and_awkward(spark, awkward, empty):
    mid = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(mid, PIECES).join(mid.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == r.lang for r in out if r.held_out]) > 0.97
    odd = langid.identify(awkward, PIECES)
    got = {r.doc_id: r for r in odd.collect()}
    assert odd.count() == awkward.count() and got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(empty, PIECES).count() == 0
    kept = langid.keep_known(mid, PIECES)
    assert kept.columns == mid.columns and kept.count() >= 0.99 * mid.count()


# 10 --------------------------------------------------------------------------


def test_token_files(spark, docs, awkward, empty, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    odd = [(1, "a <|endoftext|> b"), (1, "<|startoftext|>"), (2, "<|endoftext|><|ENDOFTEXT|>x<|"), (3, "\xbd \xb2 \u0130 <|endoftext|>")]
    special = spark.createDataFrame(odd, "doc_id long, text string")
    for name, table in (("a", docs), ("b", awkward), ("s", special)):
        parts = token_files.write_sequences(table, WORDS, length=64, batch_rows=4, folder=f"file://{tmp_path}/{name}")
        out = sorted(token_files.read_documents(spark, parts).collect(), key=lambda r: r.start)
        hashed = table.withColumn("th", F.xxhash64("text"))
        rows = sorted(hashed.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.th, r.text is not None, r.text or ""))
        start = 0
        for r, want in zip(out, rows, strict=True):
            ids = [*plain.encode(want.text or "", add_special_tokens=False).ids, 1]
            assert (r.doc_id, r.start, r.n_tokens) == (want.doc_id, start, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    assert token_files.read_documents(spark, token_files.write_sequences(empty, WORDS, folder=f"file://{tmp_path}/c")).count() == 0


def test_sequences_are_equal_length_and_masked(spark, docs, tmp_path):
    parts = token_files.write_sequences(docs, WORDS, length=64, batch_rows=4, folder=f"file://{tmp_path}/d")
    for part in parts:
        file = token_files.SequenceFile(f"{part.path}.arrow")
        real = 0
        for k in range(len(file)):
            ids, mask = file.sequence(k)
            assert len(ids) == len(mask) == 64
            real += int(mask.sum())
        assert real == part.n_tokens
        assert [len(v) for v in file.ids(10, 5)] == [5]
    assert not [p for p in tmp_path.rglob(".part*") if not p.name.endswith(".crc")]
