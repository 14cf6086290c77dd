"""Annotation files of several shapes as samples (key, media, conversation).

A conversation is an array of (instruction, output).  Media are joined by key;
what has no media is left out by the inner join and counted by ``without_media``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_text, lettered_options


def _turns(asked: Column, answered: Column) -> Column:
    return F.array(F.struct(asked.alias("instruction"), answered.alias("output")))


def pick_by_hash(options: Column, key: Column) -> Column:
    """One element of an array, the same one for a key each time."""
    return F.get(options, F.pmod(F.xxhash64(key), F.size(options)).cast("int"))


def role_conversations(df: DataFrame, key: str, media: str, turns: str = "conversations") -> DataFrame:
    """Alternating (from, value) turns: the even ones ask, the odd ones answer."""
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(turns) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(turns, 2 * i)["value"].alias("instruction"), F.get(turns, 2 * i + 1)["value"].alias("output")),
    )
    good = (F.size(turns) >= 2) & F.forall(F.transform(turns, lambda t, i: t["from"] == F.when(i % 2 == 0, "human").otherwise("gpt")), lambda ok: ok)
    return df.filter(good).select(F.col(key).alias("key"), F.col(media).alias("media"), pairs.alias("conversation"))


def captions(df: DataFrame, key: str, references: str, prompt: str = "Describe the image.") -> DataFrame:
    """One reference of each item that has one, the empty ones left out."""
    kept = F.filter(references, lambda r: F.trim(r) != "")
    return df.filter(F.size(kept) > 0).select(F.col(key).alias("key"), F.col(key).alias("media"), _turns(F.lit(prompt), pick_by_hash(kept, F.col(key))).alias("conversation"))


def multiple_choice(df: DataFrame, key: str, question: str, options: str, label: str, rationale: str, media: str) -> DataFrame:
    """Questions with lettered options; rows whose label isn't one of the first four letters go."""
    letter = F.upper(F.substring(label, 1, 1))
    asked = F.concat(F.col(question), F.lit("\n"), lettered_options(F.col(options)))
    return df.filter(letter.isin("A", "B", "C", "D")).select(F.col(key).alias("key"), F.col(media).alias("media"), _turns(asked, answer_text(letter, F.col(rationale))).alias("conversation"))


def question_answers(df: DataFrame, key: str, media: str, questions: str, answers: str) -> DataFrame:
    """Aligned arrays of questions and answers without blank or yes/no answers; rows left with none go."""
    zipped = F.zip_with(questions, answers, lambda q, a: F.struct(q.alias("instruction"), a.alias("output")))
    plain = lambda t: F.lower(F.trim(t["output"]))
    kept = F.filter(zipped, lambda t: ~plain(t).isin("yes", "no", "") & (F.trim(t["instruction"]) != ""))
    return df.select(F.col(key).alias("key"), F.col(media).alias("media"), kept.alias("conversation")).filter(F.size("conversation") > 0)


def transcriptions(df: DataFrame, key: str, text: str, prompt: str = "Read the text in the image.") -> DataFrame:
    """Images of text with what they say."""
    return df.filter(F.trim(text) != "").select(F.col(key).alias("key"), F.col(key).alias("media"), _turns(F.lit(prompt), F.col(text)).alias("conversation"))


def with_media(samples: DataFrame, media: DataFrame, key: str) -> DataFrame:
    return samples.join(media, samples.media == media[key], "inner")


def without_media(samples: DataFrame, media: DataFrame, key: str) -> DataFrame:
    return samples.join(media, samples.media == media[key], "left_anti").agg(F.count("*").alias("n_missing"))
