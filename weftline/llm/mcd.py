"""Quality rules and robust outliers: minimum covariance determinant for each language and source.

A document is described by counts over its whole text, and by three statistics
that the estimates use: the logarithms of characters per word, of marks per
character (a mark is neither letter nor numeral: punctuation and symbols), and of
repeated words per word (words less distinct ones).  Each is first drawn towards
the median document of its group as if ``shrink`` words of that were added, so
that short texts, whose shares vary most, don't look like outliers; all three
have a spread of their own in any group, none is constant.

Estimate
    For each language and source the ``coverage`` of the documents whose
    covariance has the least determinant.  Concentration steps start from several
    places: medians and interquartile ranges; the covariances of the hyperbolic
    tangent and of the direction of the standardised rows; the half nearest to
    the median; and ``FEW`` draws, by hash, of about ``DRAWN`` documents.  The
    first two steps from each run over about ``start_rows`` documents of a group.  Each step takes the documents nearest in Mahalanobis
    distance and estimates anew, which never raises the determinant.  After
    these the start with the least determinant goes on until its determinant
    settles.  The covariance is scaled to be consistent at the normal
    distribution, and the estimate is made once more from all documents within
    the ``reweight`` quantile.  A variance of ``TINY`` is added, only so that no
    matrix is singular.  Documents whose squared distance exceeds the chi-square
    quantile ``confidence`` are rejected.

Groups with fewer than ``least`` documents are pooled by language, and what is
still smaller in one pool.  Documents that fail the base rules take no part in
the estimates.

All of it is DataFrame code: the texts are read once, and the steps run over a
written table of three numbers a document.  Quantiles come from counts over fixed
bins, so no group is gathered anywhere.

Rows: null text has no words and fails; null lang or source is a group of its
own; a null id is carried like any other; repeated rows are rows like others; an
empty table gives an empty table; columns of other names are ignored, or carried
on by ``keep_good``, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import beside, counted, cut, masked, or_null, utf8

SPACE = " \\t\\n\\u000B\\u000C\\r"
STATS = ("x0", "x1", "x2")
D = len(STATS)
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
TINY = 1e-8
FEW, DRAWN = 6, 5
STARTS = 4 + FEW
FIRST_STEPS, MOST_STEPS, SETTLED = 2, 20, 5e-3
QUANTILE_BIN, DISTANCE_BINS, FARTHEST = 1e-3, 1024, 1e9


def chi_square_share(x: float, freedom: int) -> float:
    """P(chi-square <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = freedom / 2, x / 2
    total = term = 1 / a
    n = a
    while term > 1e-16 * total:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, freedom) < p else (low, middle)
    return high


def word_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_distinct, n_marks, n_repeat_words) of every row.

    ``n_repeat_words`` counts words that lie in a window of three words which
    the text has twice or more; windows are told apart by a 64-bit hash.
    """
    return _word_statistics(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            or_null(F.col("lang")).alias("lang"),
            or_null(F.col("source")).alias("source"),
            utf8(F.col(text_col).cast("string")).alias("__text"),
        )
    )


def _word_statistics(rows: DataFrame) -> DataFrame:
    """The statistics of ``__text``, which goes; all other columns stay."""
    kept = [c for c in rows.columns if c != "__text"]
    # what is left of a text without letters and numerals is short: white space and marks
    rest = rows.select(*kept, "__text", F.expr("regexp_replace(__text, '[\\\\p{L}\\\\p{N}]+', '')").alias("__rest"))
    first = rest.select(*kept, "__text", "__rest", F.expr(f"translate(__rest, '{SPACE}', '')").alias("__marks")).select(
        *kept,
        F.expr("char_length(__text) - char_length(__rest) + char_length(__marks)").cast("long").alias("word_chars"),
        F.expr("char_length(__marks) - char_length(translate(__marks, '#*$%&|<>', ''))").cast("long").alias("n_symbols"),
        F.expr("char_length(__marks)").cast("long").alias("n_marks"),
        F.expr(f"filter(split(__text, '\\n'), l -> btrim(l, '{SPACE}') <> '')").alias("__lines"),
        F.expr(f"split(btrim(__text, '{SPACE}'), '[{SPACE}]+')").alias("__w"),
    )
    counted = first.select(
        *kept,
        F.when(F.col("word_chars") == 0, 0).otherwise(F.size("__w")).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.expr("size(__lines) - size(array_distinct(__lines))").cast("long").alias("n_dup_lines"),
        F.when(F.col("word_chars") == 0, 0).otherwise(F.size(F.array_distinct("__w"))).cast("long").alias("n_distinct"),
        "n_marks",
        F.expr(
            "IF(size(__w) < 3, array(), transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])))"
        ).alias("__h"),
    )
    base = [*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_distinct", "n_marks"]
    # windows in order of their hashes, but only where some hash comes again
    ordered = counted.select(
        *base,
        F.expr(
            "IF(size(array_distinct(__h)) = size(__h), array(), sort_array(transform(__h, (h, i) -> struct(h, i AS p))))"
        ).alias("__s"),
    )
    places = ordered.select(
        *base,
        F.expr(
            "sort_array(transform(filter(__s, (x, k) -> x.h <=> get(__s, k - 1).h OR x.h <=> get(__s, k + 1).h), x -> x.p))"
        ).alias("__p"),
    )
    covered = F.expr(
        "aggregate(__p, named_struct('n', 0L, 'e', 0), (a, p) -> named_struct('n', a.n + p + 3 - greatest(p, a.e), 'e', p + 3), a -> a.n)"
    )
    return places.select(*base, covered.alias("n_repeat_words"))


def _pools(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, pool): the pool in which each group is estimated.

    A pool is named by a 64-bit hash: a broadcast table under one long key takes
    the memory of its rows, under any other key a page of tens of MB in each
    executor, and the steps broadcast some fifty tables.
    """
    groups = rows.groupBy("lang", "source").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    small = F.col("n") < least
    of_lang = groups.groupBy("lang").agg(F.sum(F.when(small, F.col("n")).otherwise(0)).alias("m"))
    pool = (
        F.when(~small, F.concat_ws("\u0001", F.lit("g"), "lang", "source"))
        .when(F.col("m") >= least, F.concat_ws("\u0001", F.lit("l"), "lang"))
        .otherwise("all")
    )
    return groups.join(of_lang, "lang").select("lang", "source", F.xxhash64(pool).alias("pool"))


def _place():
    """One number for a pool and a start."""
    return F.xxhash64("pool", "start")


def _judged(stats: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("n_again", F.col("n_words") - F.col("n_distinct"))


def _quantiles(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(pool, i, q1, q2, q3) of each column, by counts over fixed bins."""
    bins = rows.select("pool", F.posexplode(F.array(*[F.floor(F.col(c) / QUANTILE_BIN) for c in columns])).alias("i", "bin"))
    counts = bins.groupBy("pool", "i", "bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy("pool", "i")
    counts = counts.withColumn("c", F.sum("n").over(by.orderBy("bin"))).withColumn("t", F.sum("n").over(by))
    at = lambda q, name: (F.min(F.when(F.col("c") >= q * F.col("t"), F.col("bin"))) * QUANTILE_BIN + QUANTILE_BIN / 2).alias(name)
    return counts.groupBy("pool", "i").agg(at(0.25, "q1"), at(0.5, "q2"), at(0.75, "q3"))


def _one(i: int, e: str):
    return F.max(F.when(F.col("i") == i, F.col(e)))


def _shrunk(rows: DataFrame, pools: int, shrink: float) -> DataFrame:
    """``rows`` with the statistics, drawn towards the median document of their pool."""
    words, chars = F.col("n_words").cast("double"), F.col("word_chars").cast("double")
    raw = [F.log(chars / words), F.log((F.col("n_marks") + 0.5) / chars), F.log((F.col("n_again") + 0.5) / words)]
    good = rows.filter("not base_failed").select("pool", *[r.alias(f"r{i}") for i, r in enumerate(raw)])
    middle = _quantiles(good, [f"r{i}" for i in range(D)]).groupBy("pool").agg(*[F.exp(_one(i, "q2")).alias(f"t{i}") for i in range(D)])
    added = shrink * F.col("t0")
    return (
        rows.join(beside(cut(middle), pools), "pool", "left")
        .withColumn("x0", F.log((chars + added) / (words + shrink)))
        .withColumn("x1", F.log((F.col("n_marks") + added * F.col("t1")) / (chars + added)))
        .withColumn("x2", F.log((F.col("n_again") + shrink * F.col("t2")) / (words + shrink)))
        .drop("t0", "t1", "t2")
    )


def _moments(values: list) -> list:
    return [F.avg(x).alias(f"m{i}") for i, x in enumerate(values)] + [F.covar_pop(values[i], values[j]).alias(f"c{i}{j}") for i, j in PAIRS]


def _starts(rows: DataFrame, pools: int) -> DataFrame:
    """(pool, start, means, covariances) of the places that the steps start from."""
    found = _quantiles(rows, list(STATS)).groupBy("pool").agg(
        *[_one(i, "q2").alias(f"q{i}") for i in range(D)], *[(F.greatest(_one(i, "q3") - _one(i, "q1"), F.lit(QUANTILE_BIN)) / 1.349).alias(f"s{i}") for i in range(D)]
    )
    found = cut(found.join(rows.groupBy("pool").agg(F.count("*").alias("n")), "pool"))
    near = rows.join(beside(found, pools), "pool")
    z = [(F.col(x) - F.col(f"q{i}")) / F.col(f"s{i}") for i, x in enumerate(STATS)]
    length = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    near = near.select("pool", "n", *STATS, *[v.alias(f"z{i}") for i, v in enumerate(z)], length.alias("r"))
    bent = [F.tanh(f"z{i}") for i in range(D)]
    turned = [F.when(F.col("r") > 0, F.col(f"z{i}") / F.col("r")).otherwise(0.0) for i in range(D)]
    both = near.groupBy("pool").agg(*[c.alias(f"{k}_{n}") for k, v in (("a", bent), ("b", turned)) for c, n in zip(_moments(v)[D:], [f"c{i}{j}" for i, j in PAIRS])])
    half = _limits(near.select("pool", F.lit(3).alias("start"), (F.col("r") * F.col("r")).alias("d2"), F.lit(0.0).alias("logdet")), 0.5)
    inner = near.withColumn("start", F.lit(3)).withColumn("bin", _bin(F.col("r") * F.col("r"))).withColumn("place", _place()).join(beside(half, pools), "place").filter("bin <= limit")
    scaled = lambda c: [(F.col(f"{c}_c{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}")).alias(f"c{i}{j}") for i, j in PAIRS]
    middle = [F.col(f"q{i}").alias(f"m{i}") for i in range(D)]
    joined = found.join(both, "pool")
    plain = [(F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS]
    parts = [joined.select("pool", F.lit(k).alias("start"), *middle, *cov) for k, cov in enumerate((plain, scaled("a"), scaled("b")))]
    draw = lambda s: F.pmod(F.xxhash64(s, *STATS), F.col("n")) < DRAWN
    drawn = near.select("pool", *STATS, F.explode(F.filter(F.sequence(F.lit(4), F.lit(STARTS - 1)), draw)).alias("start"))
    for of in (inner, drawn):
        parts.append(of.groupBy("pool", "start").agg(*_moments(list(STATS))))
    return reduce(DataFrame.unionByName, parts)


def _factored(params: DataFrame, scale: float = 1.0) -> DataFrame:
    """(pool, start, means, Cholesky factor of the scaled covariance, logarithm of the determinant, and of that before)."""
    out = params if "was" in params.columns else params.withColumn("was", F.lit(None).cast("double"))
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}") * scale
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(0.0)) + TINY) if i == j else rest / F.col(f"l{j}{j}"))
    logs = sum((2 * F.log(f"l{i}{i}") for i in range(D)), F.lit(0.0))
    return cut(out.select("pool", "start", *[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS], logs.alias("logdet"), "was"))


def _distances(rows: DataFrame, factored: DataFrame, pools: int) -> DataFrame:
    """``rows`` with ``start``, ``logdet`` and ``d2``, the squared Mahalanobis distance in their pool; a row for each start."""
    out = rows.join(beside(factored, STARTS * pools), "pool", "left")
    total = F.lit(0.0)
    for i in range(D):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"z{k}")
        out = out.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return out.withColumn("d2", total).select(*rows.columns, "start", "logdet", "d2")


def _bin(d2):
    return F.floor(F.log1p(F.least(d2, F.lit(FARTHEST))) * DISTANCE_BINS)


def _limits(near: DataFrame, coverage: float) -> DataFrame:
    """(place, limit) of each pool and start: the bin of distance within which ``coverage`` of the rows lie."""
    counts = near.groupBy("pool", "start", _bin(F.col("d2")).alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy("pool", "start")
    counts = counts.withColumn("c", F.sum("n").over(by.orderBy("bin"))).withColumn("t", F.sum("n").over(by))
    limit = F.min(F.when(F.col("c") >= coverage * F.col("t"), F.col("bin"))).alias("limit")
    return counts.groupBy("pool", "start").agg(limit).select(_place().alias("place"), "limit")


def _concentrate(rows: DataFrame, factored: DataFrame, pools: int, coverage: float) -> DataFrame:
    """Means and covariances of the nearest ``coverage`` of each pool."""
    near = _distances(rows, factored, pools)
    limits = beside(_limits(near, coverage), STARTS * pools)
    inner = near.withColumn("bin", _bin(F.col("d2"))).withColumn("place", _place()).join(limits, "place").filter("bin <= limit")
    return _factored(inner.groupBy("pool", "start").agg(*_moments(list(STATS)), F.max("logdet").alias("was")))


def estimate(good: DataFrame, pools: int, coverage: float = 0.75, reweight: float = 0.975, start_rows: int = 500) -> DataFrame:
    """(pool, start, means, factor, logdet) of each pool of ``good`` (pool and statistics).

    Only where the steps start is found on part of the rows; the estimates are of all.
    """
    sizes = beside(cut(good.groupBy("pool").agg(F.count("*").alias("n"))), pools)
    few = cut(good.join(sizes, "pool").filter(F.pmod(F.xxhash64(F.lit("first"), *STATS), F.col("n")) < start_rows).select(*good.columns))
    tried = _factored(_starts(few, pools))
    for _ in range(FIRST_STEPS):
        tried = _concentrate(few, tried, pools, coverage)
    first = Window.partitionBy("pool").orderBy("logdet", "start")
    best = cut(tried.withColumn("place", F.row_number().over(first)).filter("place = 1").drop("place"))
    for _ in range(MOST_STEPS):
        best = _concentrate(good, best, pools, coverage)
        # the bin at the limit is in whole, so a settled determinant may still rise a little
        fallen = best.agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        if fallen is None or fallen < SETTLED:
            break
    scaled = lambda params, p: params.select("pool", "start", "logdet", *[f"m{i}" for i in range(D)], *[(F.col(f"l{i}{j}") * math.sqrt(p / chi_square_share(chi_square_quantile(p, D), D + 2))).alias(f"l{i}{j}") for i, j in PAIRS])
    within = _distances(good, scaled(best, coverage), pools).filter(F.col("d2") <= chi_square_quantile(reweight, D))
    again = within.groupBy("pool", "start").agg(*_moments(list(STATS)))
    return _factored(again, reweight / chi_square_share(chi_square_quantile(reweight, D), D + 2))


def judge(
    stats: DataFrame, coverage: float = 0.75, reweight: float = 0.975, confidence: float = 0.99999, least: int = 40, shrink: float = 100.0, start_rows: int = 500
) -> DataFrame:
    """``stats`` with base_failed, distance2 and kept."""
    rows = cut(_judged(stats))
    pooled, pools = counted(_pools(rows, least))
    rows = cut(_shrunk(rows.join(beside(pooled, pools), ["lang", "source"]), pools, shrink))
    final = estimate(rows.filter("not base_failed").select("pool", *STATS), pools, coverage, reweight, start_rows)
    limit = chi_square_quantile(confidence, D)
    verdict = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= limit)
    return _distances(rows, final, pools).withColumn("kept", verdict).withColumnRenamed("d2", "distance2").drop("pool", "start", "logdet", *STATS)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Counts, base_failed, kept and distance2 of every row; ``how``: coverage, reweight, confidence, least, shrink, start_rows."""
    return judge(word_statistics(docs, id_col, text_col), **how).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance2", 6).alias("distance2")
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps.

    Rows with one id and one text stand or fall together with their language
    and source.
    """
    plain, new, restore = masked(docs)
    identifier, text = F.col(new[id_col]).cast("long"), utf8(F.col(new[text_col]).cast("string"))
    lang, source = (or_null(F.col(new[c])) for c in ("lang", "source"))
    narrow = plain.select(identifier.alias("doc_id"), lang.alias("lang"), source.alias("source"), F.xxhash64(text).alias("th"), text.alias("__text"))
    bad = judge(_word_statistics(narrow), **how).filter("not kept").select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("lang").alias("__lang"), F.col("source").alias("__source")
    )
    same = identifier.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")) & (lang == F.col("__lang")) & (source == F.col("__source"))
    bad, n_bad = counted(bad.distinct())
    return restore(plain.join(beside(bad, n_bad), same, "left_anti"))
