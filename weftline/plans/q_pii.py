"""Queries over personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pii as p
from ..functions import text as tx
from ..operators import pii as op
from ..sources.tables import load, spread
from .catalog import query


def _in(values):
    return ", ".join("'" + v + "'" for v in values)


D = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
DISTINCT = lambda x: f"len(list_distinct(string_split({x}, '')))"
EMAIL_SQL = f"""SELECT doc_id, e AS cand FROM (SELECT doc_id, trim(unnest(regexp_extract_all(text, '{p.EMAIL}')), '.,;:)([]"''') AS e FROM documents)
WHERE split_part(e, '@', 1) <> '' AND split_part(e, '@', 2) <> '' AND lower(split_part(e, '@', 2)) NOT IN ({_in(p.PLACEHOLDER_DOMAINS)})
  AND lower(split_part(e, '@', 1)) NOT IN ({_in(p.PLACEHOLDER_LOCALS)}) AND NOT contains(lower(e), 'redacted') AND length(e) BETWEEN 6 AND 80"""
NORMAL = "CASE WHEN length(d) NOT BETWEEN 13 AND 19 THEN '' WHEN length(d) = 16 THEN d[1:4] || ' ' || d[5:8] || ' ' || d[9:12] || ' ' || d[13:16] ELSE d END"
CARD_SQL = f"""SELECT doc_id, {NORMAL} AS cand FROM (SELECT doc_id, {D('unnest(c)')} AS d FROM (SELECT doc_id, regexp_extract_all(text, '{p.CARD}') AS c FROM documents))
WHERE length(d) BETWEEN 13 AND 19 AND d NOT IN ({_in(p.PLACEHOLDER_CARDS)}) AND {DISTINCT('d')} >= 4
  AND NOT (length(d) = 16 AND ((d[1:4] = d[5:8] AND d[5:8] = d[9:12] AND d[9:12] = d[13:16]) OR d[1:1] = '0'))"""
PHONE_SQL = f"""SELECT doc_id, n AS cand FROM (SELECT doc_id, c, n, {D('n')} AS d FROM (SELECT doc_id, {D(f"regexp_extract(text, '{p.CARD}')")} AS c,
  regexp_replace(unnest(regexp_extract_all(text, '{p.PHONE}')), '[^0-9+]', '', 'g') AS n FROM documents))
WHERE length(d) BETWEEN 8 AND 16 AND n NOT IN ({_in(p.PLACEHOLDER_PHONES)}) AND {DISTINCT('d')} >= 3
  AND NOT (length(c) >= 10 AND (starts_with(d, c[1:10]) OR d[2:11] = c[1:10]))"""
ALL_SQL = f"SELECT doc_id, 'EMAIL' AS pii_type, cand FROM ({EMAIL_SQL}) UNION ALL SELECT doc_id, 'CREDIT', cand FROM ({CARD_SQL}) UNION ALL SELECT doc_id, 'PHONE', cand FROM ({PHONE_SQL})"


def _docs(spark, sf_dir):
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def _one(spark, sf_dir, f):
    return _docs(spark, sf_dir).select("doc_id", F.explode(f(F.col("text"))).alias("cand"))


@query(EMAIL_SQL)
def pii_extract_email(spark, sf_dir):
    return _one(spark, sf_dir, p.emails)


@query(CARD_SQL)
def pii_extract_card(spark, sf_dir):
    return _one(spark, sf_dir, p.cards)


@query(PHONE_SQL)
def pii_extract_phone(spark, sf_dir):
    return _one(spark, sf_dir, p.phones)


@query(f"""WITH c AS (SELECT doc_id, cand, {D('cand')} AS d FROM ({ALL_SQL}) WHERE pii_type <> 'EMAIL'),
s AS (SELECT doc_id, cand, d, list_sum(list_transform(string_split(reverse(d), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT ELSE (x::INT * 2) - CASE WHEN x::INT > 4 THEN 9 ELSE 0 END END)) AS t FROM c)
SELECT doc_id, cand, (length(d) >= 12 AND t % 10 = 0) AS luhn, CAST({DISTINCT('d')} AS INT) AS n_distinct FROM s""")
def pii_luhn(spark, sf_dir):
    c = op.candidates(_docs(spark, sf_dir), "doc_id", "text").filter("pii_type <> 'EMAIL'")
    d = tx.digits(F.col("cand"))
    return c.select("doc_id", "cand", p.luhn(d).alias("luhn"), p.distinct_characters(d).alias("n_distinct"))


def _rules(rules, text="lower(text)"):
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{r}') THEN '{n}'" for n, r in rules)


@query(f"SELECT conv_id, turn, {_rules(p.MAIN_RULES)} WHEN contains(lower(text), 'address') AND contains(text, '@') THEN 'EMAIL' END AS pii_type FROM conversations UNION ALL SELECT -doc_id - 1, 0, {_rules(p.MAIN_RULES)} WHEN contains(lower(text), 'address') AND contains(text, '@') THEN 'EMAIL' END FROM documents")
def pii_type_detect(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    d = _docs(spark, sf_dir).select((-F.col("doc_id") - 1).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "text")
    return c.unionByName(d).select("conv_id", "turn", p.pii_type(F.col("text")).alias("pii_type"))


@query(f"SELECT doc_id, {_rules(p.ALT_RULES)} END AS pii_type FROM documents")
def pii_type_detect_alt(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", p.pii_type(F.col("text"), p.ALT_RULES).alias("pii_type"))


# a name stands before each text in one of five ways: after "assigned to", as an owner, as an owner after a stop word, without a cue, not at all
@query(f"""WITH n AS (SELECT *, 'Ann ' || upper(lang[1:1]) || 'o' AS who FROM documents),
t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Card assigned to ' || who || ', for ' WHEN 1 THEN who || '''s card: ' WHEN 2 THEN 'Made for The Bank, on ' || who || '''s wish. '
  WHEN 3 THEN who || ' wrote: ' ELSE '' END || text AS t FROM n),
f AS (SELECT doc_id, trim(regexp_extract(t, '{p.NAME_AFTER}', 1)) AS a, trim(regexp_extract(t, '{p.NAME_OWNER.replace("'", "''")}', 1)) AS b,
  list_filter(regexp_extract_all(t, '{p.NAME}', 1), lambda x: lower(regexp_split_to_array(x, '\\s+')[1]) NOT IN ({_in(p.NOT_NAMES)})) AS r FROM t)
SELECT doc_id, CASE WHEN a <> '' AND lower(regexp_split_to_array(a, '\\s+')[1]) NOT IN ({_in(p.NOT_NAMES)}) THEN a
  WHEN b <> '' AND lower(regexp_split_to_array(b, '\\s+')[1]) NOT IN ({_in(p.NOT_NAMES)}) THEN b ELSE trim(r[1]) END AS name FROM f""")
def pii_name_extract(spark, sf_dir):
    who, way = F.concat(F.lit("Ann "), F.upper(F.substring("lang", 1, 1)), F.lit("o")), F.col("doc_id") % 5
    around = [("Card assigned to ", ", for "), ("", "'s card: "), ("Made for The Bank, on ", "'s wish. "), ("", " wrote: ")]
    start = F.lit("")
    for i, (before, after) in enumerate(around):
        start = F.when(way == i, F.concat(F.lit(before), who, F.lit(after))).otherwise(start)
    t = F.concat(start, "text")
    return _docs(spark, sf_dir).select("doc_id", p.person_name(t).alias("name"))


PROFILE_SQL = f"""WITH a AS ({ALL_SQL}), f AS (SELECT 'email_domain' AS facet, lower(split_part(cand, '@', 2)) AS value FROM a WHERE pii_type = 'EMAIL'
UNION ALL SELECT 'card_length', length({D('cand')})::VARCHAR FROM a WHERE pii_type = 'CREDIT'
UNION ALL SELECT 'card_separator', CASE WHEN contains(cand, ' ') THEN ' ' WHEN contains(cand, '-') THEN '-' ELSE '' END FROM a WHERE pii_type = 'CREDIT'
UNION ALL SELECT 'phone_length', length({D('cand')})::VARCHAR FROM a WHERE pii_type = 'PHONE' UNION ALL SELECT 'phone_prefix', cand[1:3] FROM a WHERE pii_type = 'PHONE')
SELECT facet, value, count(*) AS n FROM f GROUP BY ALL"""


@query(PROFILE_SQL)
def pii_profile(spark, sf_dir):
    return op.profile(op.candidates(_docs(spark, sf_dir), "doc_id", "text"), value="cand")


# an owner's name is the first two words of a text, and the address is made from it in one of eight ways
OWNERS = """o AS (SELECT doc_id, w[1] AS a, w[2] AS b FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) WHERE len(w) > 1),
s AS (SELECT *, CASE doc_id % 8 WHEN 0 THEN a || '.' || b WHEN 1 THEN a || b WHEN 2 THEN a || '_' || b WHEN 3 THEN b WHEN 4 THEN a WHEN 5 THEN a[1:1] || b WHEN 6 THEN a[1:1] || '.' || b ELSE a || '77' END AS l FROM o)"""


def _owners(spark, sf_dir):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    o = _docs(spark, sf_dir).select("doc_id", w.alias("w")).filter(F.size("w") > 1).select("doc_id", F.get("w", F.lit(0)).alias("a"), F.get("w", F.lit(1)).alias("b"))
    m, a, b, i = F.col("doc_id") % 8, F.col("a"), F.col("b"), F.substring("a", 1, 1)
    made = [F.concat(a, F.lit("."), b), F.concat(a, b), F.concat(a, F.lit("_"), b), b, a, F.concat(i, b), F.concat(i, F.lit("."), b)]
    local = F.concat(a, F.lit("77"))
    for k, x in enumerate(made):
        local = F.when(m == k, x).otherwise(local)
    return o.withColumn("local", local).withColumn("name", F.initcap(F.concat_ws(" ", "a", "b")))


@query(f"""WITH {OWNERS} SELECT doc_id, l || '@mailer.net' AS address, CASE WHEN l = a || '.' || b THEN 'first.last' WHEN l = a || b THEN 'firstlast' WHEN l = a || '_' || b THEN 'first_last' WHEN l = b THEN 'last' WHEN l = a THEN 'first'
 WHEN l = a[1:1] || b THEN 'flast' WHEN l = a[1:1] || '.' || b THEN 'f.last' ELSE 'other' END AS style FROM s""")
def pii_local_style(spark, sf_dir):
    address = F.concat("local", F.lit("@mailer.net"))
    return _owners(spark, sf_dir).select("doc_id", address.alias("address"), p.local_style(address, F.col("name")).alias("style"))


@query(f"WITH {OWNERS} SELECT doc_id % 8 AS way, round(avg((split_part(CASE WHEN length(a) > 4 THEN b || '.net' ELSE a || '.org' END, '.', 1) = b)::INT::DOUBLE), 6) AS rate FROM s GROUP BY 1")
def domain_surname_rate(spark, sf_dir):
    """How often an address' domain is its owner's surname, by the way addresses are made."""
    domain = F.when(F.length("a") > 4, F.concat("b", F.lit(".net"))).otherwise(F.concat("a", F.lit(".org")))
    o = _owners(spark, sf_dir).withColumn("address", F.concat("local", F.lit("@"), domain))
    same = p.domain_is_surname(F.col("address"), F.col("name"))
    return o.groupBy((F.col("doc_id") % 8).alias("way")).agg(F.round(F.avg(same.cast("double")), 6).alias("rate"))


@query(f"""WITH c AS ({CARD_SQL}), x AS (SELECT unnest(string_split(cand, '')) AS c, generate_subscripts(string_split(cand, ''), 1) AS i FROM c WHERE length(cand) = 19),
n AS (SELECT i, c, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT i, c, row_number() OVER (PARTITION BY i ORDER BY n DESC, c) AS rn FROM n) SELECT string_agg(c, '' ORDER BY i) AS mode FROM b WHERE rn = 1""")
def pii_char_mode(spark, sf_dir):
    return op.character_mode(_one(spark, sf_dir, p.cards).filter(F.length("cand") == 19), "cand", 19)


@query(f"""WITH c AS (SELECT DISTINCT cand AS a FROM ({CARD_SQL}) ORDER BY a LIMIT 100),
s AS (SELECT x.a, round(avg(CASE WHEN x.a = y.a THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(x.a, y.a) / greatest(length(x.a), length(y.a)) END), 9) AS score FROM c x, c y GROUP BY 1)
SELECT a AS medoid, score FROM s ORDER BY score DESC, a LIMIT 1""")
def pii_medoid(spark, sf_dir):
    return op.medoid(_one(spark, sf_dir, p.cards), "cand")


def _scored(spark, sf_dir):
    raw = F.concat(F.lit("the email is on profile "), "lang", F.when(F.col("doc_id") % 3 == 0, ", as an AI").otherwise(""))
    cand = op.candidates(_docs(spark, sf_dir).withColumn("raw", raw), "doc_id", "text", "raw")
    return op.score_candidates(cand, op.profile(cand, value="cand"))


SCORED_SQL = f"""p AS ({PROFILE_SQL}), t AS (SELECT facet, value, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn FROM p),
a AS ({ALL_SQL}), d AS (SELECT *, {D('cand')} AS d FROM a),
s AS (SELECT doc_id, pii_type, cand, 1.0::DOUBLE + 0.1::DOUBLE - CASE WHEN doc_id % 3 = 0 THEN 0.6::DOUBLE ELSE 0 END + CASE pii_type
 WHEN 'EMAIL' THEN CASE WHEN lower(split_part(cand, '@', 2)) IN (SELECT value FROM t WHERE facet = 'email_domain' AND rn <= 20) THEN 0.4::DOUBLE ELSE 0.0 END
 WHEN 'CREDIT' THEN CASE WHEN length(d) = 16 THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN length(d) >= 12 AND list_sum(list_transform(string_split(reverse(d), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN x::INT ELSE (x::INT * 2) - CASE WHEN x::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0 THEN 0.2::DOUBLE ELSE 0.0 END
   + CASE WHEN d[1:1] IN ('3', '4', '5', '6') THEN 0.1::DOUBLE ELSE 0.0 END - CASE WHEN length(d) = 16 AND d[9:12] = d[13:16] THEN 0.2::DOUBLE ELSE 0.0 END
 ELSE CASE WHEN length(d)::VARCHAR IN (SELECT value FROM t WHERE facet = 'phone_length' AND rn <= 5) THEN 0.4::DOUBLE ELSE 0.0 END + CASE WHEN starts_with(cand, '+') THEN 0.1::DOUBLE ELSE 0.0 END
   + CASE WHEN cand[1:3] IN (SELECT value FROM t WHERE facet = 'phone_prefix' AND rn <= 10 AND value <> '') THEN 0.2::DOUBLE ELSE 0.0 END END AS score FROM d)"""


@query(f"WITH {SCORED_SQL} SELECT doc_id, pii_type, cand, round(score, 6) AS score FROM s")
def pii_candidate_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "pii_type", "cand", F.round("score", 6).alias("score"))


CONSENSUS_SQL = f"""{SCORED_SQL}, k AS (SELECT doc_id, pii_type, CASE WHEN pii_type = 'EMAIL' THEN lower(cand) ELSE cand END AS k, sum(score) AS s, count(*) AS n, min(cand) AS cand FROM s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pii_type ORDER BY round(s + 0.3::DOUBLE * (n - 1), 9) DESC, k) AS rn FROM k), best AS (SELECT doc_id, pii_type, cand AS pred, round(s + 0.3::DOUBLE * (n - 1), 6) AS total, n FROM o WHERE rn = 1)"""


@query(f"WITH {CONSENSUS_SQL} SELECT * FROM best")
def pii_consensus(spark, sf_dir):
    return op.consensus(_scored(spark, sf_dir), "doc_id").withColumn("total", F.round("total", 6))


@query(f"WITH {CONSENSUS_SQL} SELECT doc_id, k AS pii_type, coalesce(pred, 'none') AS pred FROM documents CROSS JOIN (VALUES ('EMAIL'), ('CREDIT'), ('PHONE')) t(k) LEFT JOIN best USING (doc_id) WHERE best.pii_type IS NULL OR best.pii_type = k OR true QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY (best.pii_type = k) DESC NULLS LAST) = 1".replace("coalesce(pred, 'none') AS pred", "CASE WHEN best.pii_type = k THEN pred ELSE 'none' END AS pred"))
def type_grid_expand(spark, sf_dir):
    return op.type_grid(_docs(spark, sf_dir), op.consensus(_scored(spark, sf_dir), "doc_id"), "doc_id", "none")


@query()
def pii_alt_candidate(spark, sf_dir):
    t = F.col("text")
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("pii_type"), p.best_candidate(t, k).alias("cand")) for k in ("EMAIL", "CREDIT", "PHONE")]))
    found = _docs(spark, sf_dir).select("doc_id", kinds.alias("c")).select("doc_id", "c.*").filter("cand <> ''")
    return op.alt_scores(found, "doc_id")


@query()
def pii_alt_choice(spark, sf_dir):
    """The best of the alternative candidates by id and type, or a default."""
    return op.best_or_default(pii_alt_candidate(spark, sf_dir), _docs(spark, sf_dir), "doc_id", "none")


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{p.EMAIL}', '[REDACTED]', 'g'), '{p.CARD}', '[REDACTED]', 'g'), '{p.PHONE}', '[REDACTED]', 'g') AS redacted, replace(text, lang, '[REDACTED]') AS scrubbed FROM documents")
def pii_redact(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", p.redact(F.col("text")).alias("redacted"), p.scrub(F.col("text"), F.col("lang")).alias("scrubbed"))


SIM = lambda a, b: f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


@query(f"""WITH {CONSENSUS_SQL}, x AS (SELECT s.pii_type, CASE WHEN s.pii_type = 'EMAIL' THEN lower(pred) ELSE {D('pred')} END AS a, CASE WHEN s.pii_type = 'EMAIL' THEN lower(cand) ELSE {D('cand')} END AS b FROM s JOIN best USING (doc_id, pii_type)),
y AS (SELECT pii_type, {SIM('a', 'b')} AS sim FROM x) SELECT coalesce(pii_type, 'ALL') AS pii_type, count(*) AS n, round(avg(sim), 6) AS avg_sim, count(CASE WHEN sim > 0.95 THEN 1 END) AS n_exact FROM y GROUP BY ROLLUP (pii_type)""")
def leakage_report(spark, sf_dir):
    s = _scored(spark, sf_dir)
    both = s.select("doc_id", "pii_type", F.col("cand").alias("gt")).join(op.consensus(s, "doc_id"), ["doc_id", "pii_type"])
    return op.leakage_report(both).withColumn("avg_sim", F.round("avg_sim", 6))


@query("""WITH b AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS a, lead(regexp_replace(text, '[^ -~]', '', 'g')) OVER (ORDER BY item_id) AS b FROM benchmark)
SELECT item_id, round(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS sim FROM b WHERE b IS NOT NULL""")
def benchmark_similarity(spark, sf_dir):
    """Whole texts, their ASCII characters: DuckDB's levenshtein counts bytes."""
    b = load(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("a"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return pairs.select("item_id", F.round(p.similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query()
def benchmark_similarity_whole(spark, sf_dir):
    """``benchmark_similarity`` over all characters."""
    b = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"))
    pairs = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b")), "item_id")
    return pairs.select("item_id", F.round(p.similarity(F.col("a"), F.col("b")), 6).alias("sim"))


@query("""SELECT doc_id, left(rpad(trim(left(text, 8 + CAST(doc_id % 120 AS INT))), CAST(greatest(length(trim(left(text, 8 + CAST(doc_id % 120 AS INT)))), 10) AS INT), 'x'), 100) AS fitted,
 CASE WHEN doc_id % 3 = 0 THEN 'a@b.com' || 'x' WHEN doc_id % 3 = 1 THEN '+' || '12345678' ELSE 'fallback-value' END AS repaired FROM documents""")
def enforce_length(spark, sf_dir):
    m = F.col("doc_id") % 3
    kind = F.when(m == 0, "EMAIL").when(m == 1, "PHONE").otherwise("CREDIT")
    value = F.when(m == 0, "a@b.com").when(m == 1, "12345678").otherwise("12")
    short = F.substring("text", F.lit(1), (F.lit(8) + F.col("doc_id") % 120).cast("int"))
    return _docs(spark, sf_dir).select("doc_id", p.fit_length(short).alias("fitted"), p.repair_length(value, kind, F.lit("fallback-value")).alias("repaired"))


@query("SELECT lang, source AS extractor, count(*) AS n, round(avg(1.0::DOUBLE / (1 + doc_id % 4)), 6) AS avg_sim, count(CASE WHEN doc_id % 4 = 0 THEN 1 END) AS n_near, round(1 + 2 * avg(1.0::DOUBLE / (1 + doc_id % 4)), 6) AS weight FROM documents GROUP BY ALL")
def extractor_weights(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("lang", F.col("source").alias("extractor"), (1.0 / (1 + F.col("doc_id") % 4)).alias("sim"))
    out = op.extractor_weights(d, "extractor", "lang")
    return out.select("lang", "extractor", "n", F.round("avg_sim", 6).alias("avg_sim"), "n_near", F.round("weight", 6).alias("weight"))
