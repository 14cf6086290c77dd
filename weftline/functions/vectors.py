"""Arithmetic over arrays of doubles as Column expressions.

Arrays are short (classes, features): a row's array fits a task many times over.
Null arrays give null.  Indexes are zero-based, as labels are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(array: Column) -> Column:
    return array.cast("array<double>")


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: a lambda would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(x: Column, digits: int) -> Column:
    """As C and DuckDB round doubles: the scaled value, half away from zero; what is below zero and rounds to it is -0.0."""
    scaled = F.abs(x) * 10.0**digits
    return F.when(scaled < float("inf"), F.signum(x) * F.round(scaled) / 10.0**digits).otherwise(x)


def log_sum_exp(logits: Column) -> Column:
    return let(F.array_max(logits), lambda top: top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))))


def softmax(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda lse: F.transform(logits, lambda x: F.exp(x - lse)))


def log_softmax(logits: Column) -> Column:
    return let(log_sum_exp(logits), lambda lse: F.transform(logits, lambda x: x - lse))


def at(array: Column, index: Column) -> Column:
    """The element at a zero-based index; null outside."""
    return F.get(array, index)


def cross_entropy(logits: Column, label: Column) -> Column:
    return log_sum_exp(logits) - at(logits, label)


def entropy(probs: Column, eps: float = 1e-12) -> Column:
    """Shannon entropy in nats."""
    return -F.aggregate(probs, F.lit(0.0), lambda a, p: a + p * F.log(p + eps))


def confidence(probs: Column) -> Column:
    return F.array_max(probs)


def argmax(array: Column) -> Column:
    """Zero-based place of the greatest element, the first on a tie."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def margin(array: Column) -> Column:
    """Greatest less second greatest."""
    ordered = F.sort_array(array, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def norm(array: Column) -> Column:
    return F.sqrt(F.aggregate(array, F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def last_layer_gradient_norm(probs: Column, label: Column, feature: Column) -> Column:
    """Norm of the loss gradient in a last linear layer's weights and bias, in closed form.

    The weight gradient is the outer product of (probs - one-hot) and the
    feature, so its squared norm is the product of theirs.
    """
    error = F.aggregate(F.transform(probs, lambda p, i: p - F.when(i == label, 1.0).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x * x)
    size = F.aggregate(feature, F.lit(0.0), lambda a, x: a + x * x)
    return F.sqrt(error * size + error)


def rank_of(dist: Column, index: Column) -> Column:
    """One plus the number of elements above the one at ``index``."""
    return let(at(dist, index), lambda own: F.size(F.filter(dist, lambda x: x > own)) + 1)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def saturate(x: Column) -> Column:
    return x / (1.0 + x)


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def left_pad(ids: Column, length: Column, pad) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0))), ids)
