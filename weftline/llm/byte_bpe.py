"""Byte-level BPE encoding and decoding over Arrow batches.

The merges run in the tokenizers library; the vocabulary is a file of ranks
(base64 bytes and their rank, a line each).  A rank file doesn't list merges: a
pair merges if its bytes joined have a rank, lowest rank first, so the model is
given every split of each entry into two entries, in the order of ranks.  The
library works on characters, so bytes are written as the printable characters
of the usual byte-level table, and read back through its reverse.

A text is cut where matches of the pattern end anyway - before a space, and on
both sides of a newline, when neither touches other white space - and each
piece is encoded once for as long as a worker remembers it.  A text with other
white space is cut by the pattern itself.  The result is that of encoding each
match of the pattern of the whole text.

Offsets: ``spans`` maps tokens to characters by way of bytes.  A token that
starts or ends inside a character covers the whole of it, so the tokens of one
split character share it.  Decoding joins bytes, which makes split characters
whole again; ``StreamDecoder`` holds an incomplete character back until the rest
of it arrives, for ids that come in runs.

Rows: null text is empty text; empty text has no ids, and the digests of
nothing; a null id stays null; repeated rows are encoded like any other; an empty table gives an empty
table; other columns are left alone.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import given_back, local_env, only

REMEMBERED = 250_000  # pieces that a worker remembers, in each of two generations
FEW, LONGEST = 100_000, 64  # the same for ``ByteBPE``, twice for pieces after a space, and the letters of the longest it remembers


def byte_characters() -> list[str]:
    """The byte-level table: printable Latin-1 stands for itself, the rest for U+0100 and on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Memory(dict):
    """A dict that makes what it lacks, and forgets what was long not asked for."""

    def __init__(self, make, bound=REMEMBERED, longest=None):
        super().__init__()
        self.make, self.bound, self.longest, self.old = make, bound, longest, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        if self.longest is None or len(key) <= self.longest:
            self[key] = value
        return value

    def tidy(self):
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        local_env()
        import regex
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        table = byte_characters()
        self._write = dict(enumerate(table))
        self._read = {ord(c): b for b, c in enumerate(table)}
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.code = "H" if len(self.tokens) <= 1 << 16 else "I"
        spell = self._spell
        merges = [
            (spell(t[:i]), spell(t[i:])) for t in self.tokens for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        self._model = models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges)
        self.tokenizer = Tokenizer(self._model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self._pattern = regex.compile(pattern)
        self._letters = all(self._pattern.findall(x) == [x] for x in ("aBCd\u00e9F\u65e5", " aBCd\u00e9F\u65e5"))
        self._match = _Memory(self._encode_match, FEW, LONGEST)
        self._bare = _Memory(self._encode_piece, FEW, LONGEST)
        self._spaced = _Memory(lambda piece: self._encode_piece(" " + piece), 2 * FEW, LONGEST)

    def _spell(self, raw: bytes) -> str:
        return raw.decode("latin-1").translate(self._write)

    def _encode_match(self, match: str) -> bytes:
        return array(self.code, [t.id for t in self._model.tokenize(self._spell(match.encode("utf-8", "surrogatepass")))]).tobytes()

    def _encode_piece(self, piece: str) -> bytes:
        if self._letters and piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return self._encode_match(piece)  # one match of the pattern; spares most pieces its cost, and is remembered as a piece
        return b"".join(map(self._match.__getitem__, self._pattern.findall(piece)))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if " ".join(text.split()) != text.replace("\n", " "):  # white space that is not one space or one newline
            packed = b"".join(map(self._match.__getitem__, self._pattern.findall(text)))
        else:
            spaced, bare, parts = self._spaced.__getitem__, self._bare, []
            for i, line in enumerate(text.split("\n")):
                if i:
                    parts.append(bare["\n"])
                first, *rest = line.split(" ")
                parts.append(bare[first])
                parts += map(spaced, rest)
            packed = b"".join(parts)
        for memory in (self._match, self._bare, self._spaced):
            memory.tidy()
        return np.frombuffer(packed, dtype=np.dtype(self.code))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids, errors: str = "replace") -> str:
        return self.decode_bytes(ids).decode("utf-8", errors)

    def read_spelling(self, characters: str) -> bytes:
        """The reverse of the byte table: the bytes of a token as the library spells it."""
        return bytes(map(self._read.__getitem__, map(ord, characters)))

    def spans(self, ids: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in characters of the text whose bytes are ``raw``."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        leads = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
        before = np.concatenate([[0], np.cumsum(leads)])  # characters begun before each byte
        inside = np.concatenate([~leads, [False]])
        return before[starts] - inside[starts], before[ends]


class StreamDecoder:
    """Decodes ids that come in runs; a character that a run splits comes out once it is whole."""

    def __init__(self, bpe: ByteBPE, errors: str = "replace"):
        self._bpe, self._utf8 = bpe, codecs.getincrementaldecoder("utf-8")(errors)

    def feed(self, ids, final: bool = False) -> str:
        return self._utf8.decode(self._bpe.decode_bytes(ids), final)


def load(path: str, pattern: str) -> ByteBPE:
    """The model of a vocabulary, kept by the worker process as long as it asks for no other."""
    return only((path, pattern), lambda: ByteBPE(read_ranks(path), pattern))


def _texts(batch):
    for value in batch.column(1):
        yield value.as_py() or ""


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends) of every row: token ids and their spans in characters."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            ids, starts, ends = [], [], []
            for text in _texts(batch):
                found = bpe.encode(text)
                first, last = bpe.spans(found, text.encode("utf-8", "surrogatepass"))
                ids.append(found.astype(np.int32))
                starts.append(first.astype(np.int32))
                ends.append(last.astype(np.int32))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, kind) for x in (ids, starts, ends))], ["doc_id", "ids", "starts", "ends"]
            )

    return _narrow(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode, and return digests of both: nothing longer than a row of numbers leaves the worker.

    Columns: doc_id, n_tokens, ids_sha256, decoded_sha256, and n_split, the
    number of tokens that start or end inside a character.
    """

    def run(batches):
        bpe = load(path, pattern)
        decimals = [str(i).encode() for i in range(len(bpe.tokens))]
        sha = hashlib.sha256
        for batch in batches:
            counts, id_digests, text_digests, splits = [], [], [], []
            for text in _texts(batch):
                ids = bpe.encode(text)
                listed = ids.tolist()
                back = bpe.decode_bytes(listed)
                counts.append(len(listed))
                id_digests.append(sha(b" ".join(map(decimals.__getitem__, listed))).hexdigest())
                text_digests.append(sha(back).hexdigest())
                if back.isascii():
                    splits.append(0)
                else:
                    first, last = bpe.spans(ids, back)
                    # a token that begins a character and ends one has as many as its span
                    whole = np.concatenate([first[1:] >= last[:-1], [True]]) if len(ids) else np.zeros(0, bool)
                    splits.append(int((~whole | ~np.concatenate([[True], whole[:-1]])).sum()) if len(ids) else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests), pa.array(splits, pa.int64())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_split"],
            )

    return _narrow(docs, id_col, text_col).mapInArrow(
        lambda batches: given_back(run(batches)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_split long"
    )


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
