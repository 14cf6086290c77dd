"""Scores of generated sequences: which beam each token came from, and what the model gave it there.

A step of a beam search keeps some hypotheses; each extends one of the step
before (``parent``, the row of that step's scores) by a token.  Following the
parents back from a finished hypothesis gives the row of every step's scores
that its tokens were chosen from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as v

STEP = "struct<step:int,parent:int,token:int>"


def traced(choices: Column, beam: Column, length: Column) -> Column:
    """Array of (step, parent, token) of a hypothesis, in order.

    ``choices``: for each step, an array over hypotheses of (parent, token).
    The fold runs from the last step of the hypothesis to the first and carries
    the hypothesis that it is at.
    """
    steps = F.when(length > 0, F.sequence(length - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    start = F.struct(beam.cast("int").alias("at"), F.array().cast(f"array<{STEP}>").alias("path"))

    def back(state, step):
        chosen = F.get(F.get(choices, step), state["at"])
        here = F.struct(step.cast("int").alias("step"), chosen["parent"].cast("int").alias("parent"), chosen["token"].cast("int").alias("token"))
        return F.struct(here["parent"].alias("at"), F.concat(F.array(here), state["path"]).alias("path"))

    return F.aggregate(steps, start, back, lambda state: state["path"])


def transition_scores(choices: DataFrame, ends: DataFrame, scores: DataFrame, group: str = "group", normalise: bool = True) -> DataFrame:
    """(group, beam, step, parent, token, score) of each finished hypothesis at each step up to the longest of its group.

    ``choices``: (group, step, beam, parent, token), steps and beams numbered
    from 0; ``ends``: (group, beam, length), ``beam`` that of the hypothesis at
    its last step; ``scores``: (group, step, row, scores).  The score is that of
    the token in the row ``parent`` of its step, after a log-softmax over the
    whole vector if ``normalise``.  Behind a hypothesis' end, ``parent`` and
    ``token`` are null and the score is 0, so sequences of a group align.

    A group's choices, a pair for each step and beam, are gathered in one row;
    the vectors of scores are not: one row of theirs meets each token.
    """
    steps = choices.groupBy(group, "step").agg(F.array_sort(F.collect_list(F.struct("beam", "parent", "token"))).alias("__b"))
    table = steps.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "__b"))), lambda s: s["__b"]).alias("__t"))
    longest = ends.groupBy(group).agg(F.max("length").alias("__longest"))
    # a hypothesis that ended early was extended by nothing: it is traced from its own last step
    paths = ends.join(table, group).join(longest, group).select(group, "beam", "length", "__longest", traced(F.col("__t"), F.col("beam"), F.col("length").cast("int")).alias("__p"))
    aligned = F.explode(F.sequence(F.lit(0), F.col("__longest") - 1)).alias("step")
    at = lambda name: F.when(F.col("step") < F.col("length"), F.get("__p", F.col("step").cast("int"))[name])
    rows = paths.filter("__longest > 0").select(group, "beam", "length", "__p", aligned).select(group, "beam", F.col("step").cast("int").alias("step"), at("parent").alias("parent"), at("token").alias("token"))
    values = v.log_softmax(F.col("scores")) if normalise else F.col("scores")
    met = rows.join(scores.select(group, "step", F.col("row").alias("parent"), "scores"), [group, "step", "parent"], "left")
    return met.select(group, "beam", "step", "parent", "token", F.when(F.col("token").isNull(), 0.0).otherwise(v.at(values, F.col("token"))).alias("score"))


def sequence_scores(transitions: DataFrame, group: str = "group", length_penalty: float = 1.0) -> DataFrame:
    """(group, beam, n_tokens, score): the sum of a hypothesis' scores over its length to the power of the penalty; null without tokens."""
    n = F.count("token")
    return transitions.groupBy(group, "beam").agg(n.alias("n_tokens"), F.try_divide(F.sum("score"), F.pow(n.cast("double"), F.lit(length_penalty))).alias("score"))
