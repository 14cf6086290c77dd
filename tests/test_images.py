"""Resizing and scales of images, and scores along beams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import beams, images


def _resized(image, height, width):
    """Every pixel as a weighted mean over a triangle, in plain loops."""

    def line(values, n):
        scale, out = len(values) / n, []
        reach = max(scale, 1.0)
        for i in range(n):
            c = (i + 0.5) * scale
            w = [max(0.0, 1 - abs(x + 0.5 - c) / reach) for x in range(len(values))]
            out.append(sum(a * b for a, b in zip(w, values)) / sum(w))
        return out

    rows = [line(r, width) for r in image]
    return [list(r) for r in zip(*[line(c, height) for c in zip(*rows)])]


@pytest.mark.parametrize("size", [(3, 5), (8, 8), (16, 16), (1, 1), (5, 20)])
def test_resize(spark, size):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(6, 8, 3))
    df = spark.createDataFrame([(0, a.ravel().tolist()), (1, None), (2, [1.0])], "id int, i array<double>")
    got = {r.id: r.o for r in images.resized(df, "i", "o", 6, 8, *size, channels=3).collect()}
    want = np.stack([_resized(a[:, :, c].tolist(), *size) for c in range(3)], axis=-1)
    assert np.allclose(np.reshape(got[0], want.shape), want, atol=1e-12) and got[1] is None and got[2] is None


def test_weights_of_the_same_size_copy_and_flat_images_stay_flat(spark):
    assert [[w for w in row if w > 0] for _, row in images.triangle_weights(9, 9)] == [[1.0]] * 9
    for n in (1, 2, 5, 23):
        assert all(math.isclose(sum(w), 1) for _, w in images.triangle_weights(9, n))


def test_scale_and_order_of_axes(spark):
    rng = np.random.default_rng(1)
    share, level = rng.random((4, 2, 3, 3)), rng.integers(0, 256, (4, 2, 3, 3)).astype(float)
    level[1:] /= 255  # one image of a set in levels decides for all of it
    rows = [("a", i, x.ravel().tolist()) for i, x in enumerate(share)] + [(None, i, x.ravel().tolist()) for i, x in enumerate(level)] + [("e", 0, None), ("e", 1, [1.0])]
    df = spark.createDataFrame(rows, "s string, n int, i array<double>")
    means, stds = [0.1, 0.2, 0.3], [0.5, 0.25, 2.0]
    got = {(r.s, r.n): r.x for r in images.normalised(df, ["s"], "i", (2, 3, 3), means, stds).collect()}
    for s, data, scale in (("a", share, 1), (None, level, 255)):
        want = (data.transpose(0, 3, 1, 2) / scale - np.reshape(means, (3, 1, 1))) / np.reshape(stds, (3, 1, 1))
        assert all(np.allclose(got[s, i], w.ravel(), atol=1e-12) for i, w in enumerate(want))
    assert got["e", 0] is None and got["e", 1] is None
    first = images.normalised(df.filter("s = 'a'"), ["s"], "i", (3, 3, 2), means, stds).collect()
    assert all(np.allclose(r.x, (share[r.n].reshape(3, 6) - np.reshape(means, (3, 1))).ravel() / np.repeat(stds, 6)) for r in first)
    with pytest.raises(ValueError):
        images.normalised(df, ["s"], "i", (2, 9, 1), means, stds)


def _gathered(sequences, scores, beam_indices, normalise):
    """Scores (steps, beams, words) by rows of beam indices, with -1 behind the end."""
    s = scores - np.log(np.exp(scores).sum(axis=-1, keepdims=True)) if normalise else scores
    longest = int((beam_indices >= 0).sum(axis=1).max())
    return [[0.0 if beam_indices[i, t] < 0 else s[t, beam_indices[i, t], sequences[i, t]] for t in range(longest)] for i in range(len(sequences))]


@pytest.mark.parametrize("normalise", [True, False])
def test_transition_scores(spark, normalise):
    rng = np.random.default_rng(2)
    choice_rows, end_rows, score_rows, want = [], [], [], {}
    for g in range(5):
        steps, n, words = 3 + g, 3, 11
        scores = rng.normal(size=(steps, n, words))
        parent, token = rng.integers(0, n, (steps, n)), rng.integers(0, words, (steps, n))
        lengths = [steps - (g + b) % 3 for b in range(n)] if g else [0, 1, 2]
        beam_indices, sequences = np.full((n, steps), -1), np.zeros((n, steps), dtype=int)
        for b in range(n):
            at = b
            for t in range(lengths[b] - 1, -1, -1):
                sequences[b, t], beam_indices[b, t] = token[t, at], parent[t, at]
                at = parent[t, at]
        want[g] = _gathered(sequences, scores, beam_indices, normalise)
        choice_rows += [(g, t, b, int(parent[t, b]), int(token[t, b])) for t in range(steps) for b in range(n)]
        end_rows += [(g, b, lengths[b]) for b in range(n)]
        score_rows += [(g, t, b, scores[t, b].tolist()) for t in range(steps) for b in range(n)]
    choices = spark.createDataFrame(choice_rows, "group int, step int, beam int, parent int, token int")
    ends = spark.createDataFrame(end_rows, "group int, beam int, length int")
    got = beams.transition_scores(choices, ends, spark.createDataFrame(score_rows, "group int, step int, row int, scores array<double>"), normalise=normalise)
    found = {(r.group, r.beam, r.step): r.score for r in got.collect()}
    assert len(found) == sum(len(rows) * len(rows[0]) for rows in want.values())
    assert all(math.isclose(found[g, b, t], x, abs_tol=1e-9) for g, rows in want.items() for b, row in enumerate(rows) for t, x in enumerate(row))
    total = {(r.group, r.beam): r for r in beams.sequence_scores(got, length_penalty=2.0).collect()}
    assert math.isclose(total[3, 1].score, sum(want[3][1]) / total[3, 1].n_tokens ** 2, abs_tol=1e-9)
    assert got.filter(F.col("token").isNull() & (F.col("score") != 0)).count() == 0
