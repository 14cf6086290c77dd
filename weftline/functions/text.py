"""Text statistics as Column expressions; everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vectors import let

# fixed values: patterns that decide what counts as a word, a mark, a sentence end
WORD = r"[\p{L}\p{N}_]+"
PUNCTUATION = r"[.,;:!?\-—'\"()\[\]{}]"
SENTENCE_END = r"[.!?]+\s+"


def words(text: Column) -> Column:
    """Lower-cased words; letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Number of characters that match a one-character class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(part.cast("double") / whole.cast("double"))


def distinct_words(w: Column) -> Column:
    return F.size(F.array_distinct(w)).cast("long")


def mean_length(w: Column) -> Column:
    total = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return ratio(total, F.size(w))


def std_length(w: Column) -> Column:
    n = F.size(w).cast("double")
    square = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x) * F.length(x))
    variance = square / n - mean_length(w) * mean_length(w)
    return F.when(F.size(w) == 0, 0.0).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0))))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), SENTENCE_END), lambda s: F.trim(s) != "")


def bigrams(w: Column) -> Column:
    n = F.size(w)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws("\u0001", a, b))
    )


def run_lengths(items: Column) -> Column:
    """How often each distinct item of an array occurs, within the row: lengths of the runs of the sorted array."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(s, i - 1) != F.get(s, i)))
        return let(ends, lambda e: F.transform(e, lambda x, k: x - F.coalesce(F.get(e, k - 1), F.lit(0))))

    return F.when(F.size(items) == 0, F.array().cast("array<int>")).otherwise(let(F.sort_array(items), of_sorted))


def item_entropy(items: Column) -> Column:
    """Base-2 Shannon entropy of the items of an array; 0 without items."""

    def of_counts(c: Column) -> Column:
        n = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        return F.log2(n) - F.aggregate(c, F.lit(0.0), lambda a, x: a + x * F.log2(x)) / n

    return F.when(F.size(items) == 0, 0.0).otherwise(let(run_lengths(items), of_counts))


def repeat_rate(items: Column) -> Column:
    """Share of the items of an array that occur in it more than once; 0 without items."""
    again = F.aggregate(run_lengths(items), F.lit(0).cast("long"), lambda a, x: a + F.when(x > 1, x).otherwise(0))
    return ratio(again, F.size(items))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def burstiness(text: Column) -> Column:
    """Population standard deviation over mean of words per sentence; 0 below two sentences."""
    lengths = F.transform(sentences(text), lambda s: F.size(words(s)).cast("double"))
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def finish(a: Column) -> Column:
        mean = a["s"] / a["n"]
        return F.when(a["n"] < 2, 0.0).otherwise(F.sqrt(F.greatest(a["q"] / a["n"] - mean * mean, F.lit(0.0))) / (mean + 1e-9))

    # one pass: the lengths are not worth keeping, and a second look would find them anew
    return F.aggregate(
        lengths, start, lambda a, x: F.struct((a["n"] + 1).alias("n"), (a["s"] + x).alias("s"), (a["q"] + x * x).alias("q")), finish
    )


def stylometry(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The fifteen features, one row for each row of ``df``.

    Null text counts as empty.  Words are found once, and items are counted
    within the row: nothing is shuffled.
    """
    base = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    t = F.col("__t")
    wide = base.withColumn("__w", words(t))
    w, n = F.col("__w"), F.length(t)
    return wide.select(
        key,
        n.cast("long").alias("stat_n_chars"),
        F.size(w).cast("long").alias("stat_n_words"),
        distinct_words(w).alias("stat_n_unique_words"),
        ratio(distinct_words(w), F.size(w)).alias("stat_ttr"),
        mean_length(w).alias("stat_avg_word_len"),
        std_length(w).alias("stat_std_word_len"),
        ratio(matches(t, PUNCTUATION), n).alias("stat_punct_rate"),
        ratio(matches(t, r"\n"), n).alias("stat_newline_rate"),
        ratio(matches(t, r"\p{Lu}"), n).alias("stat_uppercase_rate"),
        ratio(matches(t, r"\p{Nd}"), n).alias("stat_digit_rate"),
        F.size(sentences(t)).cast("long").alias("stat_n_sentences"),
        burstiness(t).alias("stat_sent_burstiness"),
        item_entropy(characters(t)).alias("stat_char_entropy"),
        item_entropy(w).alias("stat_word_entropy"),
        repeat_rate(bigrams(w)).alias("stat_bigram_repeat_rate"),
    )


STYLOMETRY = [
    "stat_n_chars", "stat_n_words", "stat_n_unique_words", "stat_ttr", "stat_avg_word_len", "stat_std_word_len", "stat_char_entropy", "stat_word_entropy",
    "stat_bigram_repeat_rate", "stat_punct_rate", "stat_newline_rate", "stat_uppercase_rate", "stat_digit_rate", "stat_n_sentences", "stat_sent_burstiness",
]


# --- other scalars ---------------------------------------------------------


def cache_tag(name: Column) -> Column:
    return F.translate(F.lower(name), "/-.", "___")


def stringify(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def clean_edges(text: Column) -> Column:
    """Drop role marks and a leading label, then strip quotes and punctuation at both ends."""
    out = stringify(text)
    # fixed values: marks, labels and edge characters that are dropped
    for mark in ("<|user|>", "<|assistant|>", "<s>", "</s>", "```"):
        out = F.replace(out, F.lit(mark), F.lit(""))
    out = F.regexp_replace(F.trim(out), r"(?i)^(answer|pred|prediction|email|phone|credit|card|number)\s*[:：]\s*", "")
    return F.btrim(F.trim(out), F.lit(" \t\r\n\"'`*_.,;:!?#[]{}()<>"))


def local_part(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def domain_part(address: Column) -> Column:
    return F.regexp_extract(address, r"(?s)^[^@]*@(.*)$", 1)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def lettered_options(options: Column) -> Column:
    """The first four options, one a line, as ``A. ...``."""
    return F.array_join(F.transform(F.slice(options, 1, 4), lambda x, i: F.concat(F.chr(i + 65), F.lit(". "), x)), "\n")


def answer_text(answer: Column, rationale: Column) -> Column:
    return F.concat(F.lit("The answer is "), answer, F.lit(". "), rationale)


def formatted_question(question: Column, modalities: list[str], passage: Column | None = None, insert: bool = True) -> Column:
    """A question in its marks, behind the marks of what it is about."""
    body = F.replace(F.replace(F.trim(question), F.lit("<image>"), F.lit("")), F.lit("<audio>"), F.lit(""))
    parts = []
    for modality in modalities if insert else []:
        if modality in ("image", "audio"):
            parts.append(F.lit(f"<{modality}_start><{modality}><{modality}_end>\n"))
        elif modality == "text":
            given = F.when(F.coalesce(passage, F.lit("")) == "", F.raise_error(F.lit("text needs a passage"))).otherwise(passage) if passage is not None else None
            if given is None:
                raise ValueError("text needs a passage")
            parts.append(F.concat(F.lit("You are given the following text passage: "), given, F.lit("\n")))
        else:
            raise ValueError(f"unsupported modality: {modality}")
    return F.concat(*parts, F.lit("<question_start>"), body, F.lit("<question_end>"))


def chat_prompt(system: Column, user: Column, first: Column) -> Column:
    """System message on the first turn only, the user's turn, and the mark that asks for a reply."""
    head = F.when(first, F.concat(F.lit("<|system|>\n"), system, F.lit("\n"))).otherwise("")
    return F.concat(head, F.lit("<|user|>\n"), user, F.lit("\n<|assistant|>\n"))


def before_question(text: Column) -> Column:
    """Text up to the end of the first image or audio mark; all of it if there is none."""
    end = F.regexp_extract(text, r"(?s)^(.*?<(?:image|audio)_end>)", 1)
    return F.when(end == "", text).otherwise(end)


def marked_integers(text: Column, name: str = "vqgan") -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(rf"<{name}_(\d+)>"), F.lit(1)), lambda x: x.cast("int"))


def file_stem(path: Column, sep: str = "_") -> Column:
    """The last part of a file's name, without its ending."""
    return F.element_at(F.split(F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1), sep), -1)


def join_strings(*columns: Column) -> Column:
    return F.concat_ws(" ", *columns)


def first_appearance(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("__n = 1").drop("__n")
