"""Language identification by unigram pieces, with segmentation summed out.

The pieces are the lower-case letter entries of a fixed public vocabulary; each
learned language has a probability for each piece.  The probability of a word is
the sum over all ways to cut it into pieces of the product of their
probabilities, which a forward pass over the positions of the word gives without
listing them.  Pieces never cross words, so a text's log-probability is the sum
over its words, and a word is worked out once for as long as a worker remembers
it: two generations of ``remembered`` words, of which what is asked for again
goes on.  New words of a batch of documents are worked out together: the forward pass
runs over arrays that hold one position of all of them.

Piece probabilities are learned by expectation maximisation over the same
lattices, from a bounded sample of labelled texts of each language (``per_lang``
documents, whole, chosen by hash of the id, as many of them as have
``most_bytes`` together, or an equal part of ``all_bytes`` where there are many
languages) and smoothed towards the pool of all languages.  A letter that no
piece covers has one small probability in every language.  Words are never cut,
and words of any length are learned from: those of more than ``LONGEST`` letters,
as in scripts without spaces, take the same passes one at a time, in logarithms.

The prediction is the likeliest language, the first by name on a tie; the score
is its share of the likelihoods after the root of the number of words is taken,
so that it doesn't run to one on any long text.

Rows: null text, or one without letters (characters of the Unicode classes L),
is ``und`` with score 0; if nothing could be learned every text is ``und``; a
null id isn't held out, and not learned from; repeated rows are rows like
others; an empty table gives an empty table; other columns are ignored, or
carried on by ``keep_known``.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import beside, counted, crc_mod, given_back, masked, only, utf8

LONGEST = 24
MOST_TEXTS, MOST_CHARS = 256, 1 << 20  # worked out together
LONGEST_PIECE = 16  # letters of the vocabulary's longest piece, mark included
FLOOR = 1e-8
START = "▁"
_LETTERS = re.compile(r"[^\W\d_]+")
_SLOTS = 20  # the lookup table has 2 ** 20 slots


def vocabulary(path: str) -> list[str]:
    """Pieces made of lower-case letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).lower()
        body = piece[1:] if piece.startswith(START) else piece
        if body.isalpha() or piece == START:
            found.add(piece)
    return sorted(found)


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case and marked."""
    out = []
    for run in _LETTERS.findall(text.lower()):
        # numerals that aren't digits, as fractions, stand among letters there
        parts = [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
        out += [START + part for part in parts]
    return out


class Lattice:
    """Finds the pieces of many words at once."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.unknown = len(pieces)  # stands for a letter that isn't a piece
        self.none = len(pieces) + 1
        self.at = {piece: i for i, piece in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self._weights = np.uint64(0x9E3779B97F4A7C15) ** np.arange(LONGEST + 2, dtype=np.uint64)
        self._keys = np.zeros(len(pieces) + 2, dtype=np.uint64)
        for i, piece in enumerate(pieces):
            self._keys[i] = self._hashes([piece], len(piece))[:, -1][0]
        self._tables = []
        left = np.arange(len(pieces))
        for multiplier in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            table = np.full(1 << _SLOTS, self.none, dtype=np.int32)
            slots = self._slots(self._keys[left], np.uint64(multiplier))
            table[slots] = left
            self._tables.append((np.uint64(multiplier), table))
            left = left[table[slots] != left]
            if not len(left):
                break
        assert not len(left), "two pieces have one key"

    @staticmethod
    def _slots(keys, multiplier):
        return ((keys * multiplier) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _hashes(self, words: list[str], n: int) -> np.ndarray:
        """Hash of each prefix of words of ``n`` letters."""
        letters = np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(len(words), n).astype(np.uint64)
        mixed = (letters + np.uint64(0x1234567)) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        out = np.zeros((len(words), n + 1), dtype=np.uint64)
        for i in range(n):
            out[:, i + 1] = out[:, i] * self._weights[1] + mixed[:, i]
        return out

    def edges(self, words: list[str], n: int):
        """(start, end, piece of each word) for the stretches that are a piece in some word."""
        prefix = self._hashes(words, n)
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                keys = prefix[:, end] - prefix[:, start] * self._weights[end - start]
                found = np.full(len(words), self.none, dtype=np.int32)
                for multiplier, table in self._tables:
                    at = table[self._slots(keys, multiplier)]
                    found = np.where(self._keys[at] == keys, at, found)
                if end - start == 1:
                    found = np.where(found == self.none, self.unknown, found)
                if (found != self.none).any():
                    yield start, end, found

    def edges_of(self, word: str, end: int) -> list[tuple[int, int]]:
        """(start, piece) for the pieces of one word that end at ``end``."""
        found = [(start, self.at[word[start:end]]) for start in range(max(0, end - self.longest), end) if word[start:end] in self.at]
        return found if found and found[-1][0] == end - 1 else [*found, (end - 1, self.unknown)]


def _by_length(words: list[str]) -> dict[int, list[int]]:
    groups: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        groups.setdefault(len(word), []).append(i)
    return groups


def _long_word(lattice: Lattice, logs: np.ndarray, word: str) -> np.ndarray:
    """Log-probability of one word of any length in each language.  ``logs``: of the pieces' probabilities."""
    forward = np.zeros((len(word) + 1, logs.shape[1]))
    for end in range(1, len(word) + 1):
        terms = np.array([forward[start] + logs[piece] for start, piece in lattice.edges_of(word, end)])
        top = terms.max(axis=0)
        forward[end] = top + np.log(np.exp(terms - top).sum(axis=0))
    return forward[len(word)]


def _long_uses(edges: list[list[tuple[int, int]]], probability: list[float], count: float, used: np.ndarray) -> None:
    """Add to ``used`` the expected uses of the pieces of one word in one language.

    ``edges``: for each end, the pieces that end there.  The forward pass is in
    logarithms; then, from the end of the word on, the weight of each position is
    shared out among the pieces that lead to it.
    """
    forward = [0.0]
    for inward in edges:
        terms = [forward[start] + math.log(probability[piece]) for start, piece in inward]
        top = max(terms)
        forward.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    weight = [0.0] * len(edges) + [count]
    for end in range(len(edges), 0, -1):
        for start, piece in edges[end - 1]:
            share = weight[end] * math.exp(forward[start] - forward[end]) * probability[piece]
            weight[start] += share
            used[piece] += share


def word_log_probabilities(lattice: Lattice, probabilities: np.ndarray, words: list[str]) -> np.ndarray:
    """A row for each word: its log-probability in each language.  ``probabilities``: piece by language."""
    out = np.zeros((len(words), probabilities.shape[1]))
    for n, where in _by_length(words).items():
        if n > LONGEST:
            logs = np.log(np.maximum(probabilities, 1e-300))
            for i in where:
                out[i] = _long_word(lattice, logs, words[i])
            continue
        some = [words[i] for i in where]
        forward = np.zeros((n + 1, len(some), probabilities.shape[1]))
        forward[0] = 1.0
        for start, end, found in lattice.edges(some, n):
            forward[end] += forward[start] * probabilities[found]
        out[where] = np.log(forward[n])
    return out


def _expected(lattice: Lattice, probabilities: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, by forward and backward passes; words of more than ``LONGEST`` letters one by one."""
    used = np.zeros_like(probabilities)
    columns = np.maximum(probabilities, 1e-300).T.tolist()
    for n, where in _by_length(words).items():
        if n > LONGEST:
            for i in where:
                edges = [lattice.edges_of(words[i], end) for end in range(1, n + 1)]
                for k in np.flatnonzero(counts[i]):
                    _long_uses(edges, columns[k], float(counts[i, k]), used[:, k])
            continue
        some = [words[i] for i in where]
        edges = list(lattice.edges(some, n))
        shape = (n + 1, len(some), probabilities.shape[1])
        forward, backward = np.zeros(shape), np.zeros(shape)
        forward[0] = backward[n] = 1.0
        for start, end, found in edges:
            forward[end] += forward[start] * probabilities[found]
        for start, end, found in reversed(sorted(edges, key=lambda e: e[0])):
            backward[start] += backward[end] * probabilities[found]
        weight = counts[where] / forward[n]
        for start, end, found in edges:
            share = forward[start] * probabilities[found] * backward[end] * weight
            for k in range(used.shape[1]):
                used[:, k] += np.bincount(found, share[:, k], minlength=len(used))
    return used


def learn(texts: list[tuple[str, str]], pieces: list[str], rounds: int = 3, smooth: float = 0.05) -> tuple[list[str], np.ndarray]:
    """Languages and the probability of each piece in each, from (language, text) pairs."""
    langs = sorted({lang for lang, _ in texts})
    tallies = {lang: Counter() for lang in langs}
    for lang, text in texts:
        tallies[lang].update(words_of(text))
    words = sorted(set().union(*tallies.values())) if langs else []
    counts = np.array([[tallies[lang][w] for lang in langs] for w in words], dtype=float).reshape(len(words), len(langs))
    lattice = Lattice(pieces)
    p = np.full((len(pieces) + 2, len(langs)), 1.0 / max(1, len(pieces)))
    p[lattice.unknown], p[lattice.none] = FLOOR, 0.0
    for _ in range(rounds):
        used = _expected(lattice, p, words, counts)[: len(pieces)] if words else np.zeros((len(pieces), len(langs)))
        own = used / np.maximum(used.sum(axis=0), 1e-300)
        pool = own.mean(axis=1, keepdims=True) if langs else own
        p[: len(pieces)] = np.maximum((1 - smooth) * own + smooth * pool, FLOOR)
    return langs, p


def _together(texts: list[str]):
    """The texts in groups of ``MOST_TEXTS`` and ``MOST_CHARS`` at most, or of one."""
    some, chars = [], 0
    for text in texts:
        if some and (len(some) == MOST_TEXTS or chars + len(text) > MOST_CHARS):
            yield some
            some, chars = [], 0
        some.append(text)
        chars += len(text)
    if some:
        yield some


class Scorer:
    def __init__(self, langs: list[str], probabilities: np.ndarray, pieces: list[str], remembered: int = 60_000):
        self.langs, self._p, self._lattice, self._bound = langs, probabilities, Lattice(pieces), remembered
        self._age()
        self._age()

    def _age(self):
        """Forget the older words; the newer ones are the older now."""
        nothing = {}, np.zeros((0, len(self.langs) + 1))
        self._old, self._old_scores = (self._index, self._scores) if hasattr(self, "_index") else nothing
        self._index, self._scores = nothing

    def _learn_words(self, raw: list[str]):
        """Rows of log-probabilities, and number of letter runs, for strings without white space."""
        places = np.fromiter((self._old.get(w, -1) for w in raw), np.int64, len(raw))
        out = np.zeros((len(raw), len(self.langs) + 1))
        out[places >= 0] = self._old_scores[places[places >= 0]]
        out[places < 0] = self._worked_out([raw[i] for i in np.flatnonzero(places < 0)])
        self._scores = np.concatenate([self._scores, out])

    def _worked_out(self, raw: list[str]) -> np.ndarray:
        parts = [words_of(w) for w in raw]
        flat = sorted({w for ws in parts for w in ws})
        at = {w: i for i, w in enumerate(flat)}
        known = word_log_probabilities(self._lattice, self._p, flat)
        new = np.zeros((len(raw), len(self.langs) + 1))
        for i, ws in enumerate(parts):
            for w in ws:
                new[i, :-1] += known[at[w]]
            new[i, -1] = len(ws)
        return new

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        langs, scores = [], []
        for some in _together(texts):
            found = self._predicted(some)
            langs += found[0]
            scores += found[1]
        return langs, scores

    def _predicted(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if len(self._index) > self._bound:
            self._age()
        index, lists, new = self._index, [], []
        for text in texts:
            words = text.split()
            for word in set(words).difference(index):
                index[word] = len(index)
                new.append(word)
            lists.append(np.fromiter(map(index.__getitem__, words), np.int64, len(words)))
        self._learn_words(new)
        langs, scores = [], []
        for at in lists:
            total = self._scores[at].sum(axis=0)
            n, logs = total[-1], total[:-1]
            if n < 1:
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(logs.argmax())
            langs.append(self.langs[best])
            scores.append(float(1 / np.exp((logs - logs[best]) / np.sqrt(n)).sum()))
        return langs, scores


def training_texts(docs: DataFrame, per_lang: int, most_bytes: int, id_col: str, text_col: str, lang_col: str, all_bytes: int = 256_000_000) -> list[tuple[str, str]]:
    """At most ``per_lang`` (language, text) pairs of each language, ``most_bytes`` of its text and ``all_bytes`` of all, outside the held-out fifth."""
    eligible = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (crc_mod(F.col(id_col), 5) != 0))
    n_langs = eligible.select(lang_col).distinct().count()
    most_bytes = min(most_bytes, all_bytes // max(1, n_langs))
    size, mark = F.octet_length(F.col(text_col).cast("string")), F.xxhash64(F.col(text_col).cast("string"))
    order = Window.partitionBy("__lang").orderBy("__h", "__id", "__mark")
    chosen = (
        eligible.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.xxhash64(F.col(id_col).cast("string")).alias("__h"), size.alias("__size"), mark.alias("__mark"))
        .filter(F.col("__size") <= most_bytes)
        .withColumn("__n", F.row_number().over(order))
        .filter(F.col("__n") <= per_lang)
        .withColumn("__sum", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("__sum") <= most_bytes)
        .select("__id", "__lang", "__mark")
    )
    chosen, n_chosen = counted(chosen.distinct())
    same = (F.col(id_col) == F.col("__id")) & (F.col(lang_col) == F.col("__lang")) & (mark == F.col("__mark"))
    rows = eligible.join(beside(chosen, n_chosen), same, "left_semi").select(lang_col, text_col)
    # rows that repeat an id and its text would each come: one of them is enough
    rows = rows.distinct().collect()
    return sorted((row[0], row[1]) for row in rows)


def identify(docs: DataFrame, path: str, per_lang: int = 250, most_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), utf8(F.col(text_col).cast("string")).alias("text"), F.coalesce(crc_mod(F.col(id_col), 5) == 0, F.lit(False)).alias("held_out")
    )
    return _identify(docs, narrow, path, per_lang, most_bytes, id_col, text_col, lang_col)


def _identify(docs, narrow, path, per_lang, most_bytes, id_col, text_col, lang_col) -> DataFrame:
    """lang_pred and score beside the columns of ``narrow`` but its text."""
    pieces = vocabulary(path)
    langs, p = learn(training_texts(docs, per_lang, most_bytes, id_col, text_col, lang_col), pieces)
    shared = docs.sparkSession.sparkContext.broadcast((langs, p, pieces))  # pieces times languages numbers
    kept = [c for c in narrow.columns if c != "text"]
    key = f"langid-{uuid.uuid4().hex}"

    def run(batches):
        scorer = only(key, lambda: Scorer(*shared.value))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found, scores = [], []
            for i in range(0, len(texts), MOST_TEXTS):
                some = scorer.predict(texts.slice(i, MOST_TEXTS).to_pylist())
                found += some[0]
                scores += some[1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*kept, "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema if f.name != "text")
    return narrow.mapInArrow(lambda batches: given_back(run(batches)), f"{kinds}, lang_pred string, score double")


def keep_known(docs: DataFrame, path: str, per_lang: int = 250, most_bytes: int = 4_000_000, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more.

    Rows with one id and one text stand or fall together.
    """
    plain, new, restore = masked(docs)
    identifier, text = F.col(new[id_col]).cast("long"), utf8(F.col(new[text_col]).cast("string"))
    narrow = plain.select(identifier.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    told = _identify(plain, narrow, path, per_lang, most_bytes, new[id_col], new[text_col], new[lang_col])
    bad = told.filter((F.col("lang_pred") == "und") | (F.col("score") < least)).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    bad, n_bad = counted(bad.distinct())
    same = identifier.eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th"))
    return restore(plain.join(beside(bad, n_bad), same, "left_anti"))
