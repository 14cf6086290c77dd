"""Token-id output: Arrow files of equal-length sequences with masks.

Documents are encoded with the tokenizers library, an end id is appended to
each, and the ids are laid end to end in ascending doc_id order.  Each partition
of that order writes two files of Arrow's random-access stream-file format:

``part-NNNNN.arrow``
    record batches of ``batch_rows`` sequences, with ``input_ids``, a
    fixed-size list of unsigned integers (two bytes each where the vocabulary
    allows it), and ``mask``, a fixed-size list of booleans that is false over
    the padding of the last sequence.  Every batch but the last has the same
    number of sequences, so sequence *k* is row ``k % batch_rows`` of batch
    ``k // batch_rows``, read from a memory map without a copy.
``part-NNNNN.docs.arrow``
    doc_id, start (in this part's ids) and n_tokens of each document.

A file is written under a name of its own attempt and moved into place when
whole, so that a task that runs twice leaves the same one file.  What goes to
the driver is a row for each part.

A word is encoded once for as long as a worker remembers it: the vocabulary's
pre-tokenizer drops white space and no token crosses it, so the ids of a text
are those of its words.  The file's special tokens, where a text spells them,
have their own ids, as the library gives them; they cut the text.

Rows: null text counts as empty and has the end id alone; documents with equal
ids follow one another in the order of a hash of their texts, then of the texts,
so that an id that many documents share isn't one task's; null ids come first;
an empty table writes no file and gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import local_env, shared_dir, spread
from .byte_bpe import REMEMBERED, _Memory, byte_characters

SUMMARY = "part int, path string, n_docs long, n_tokens long"


class WordEncoder:
    """Ids of whole texts by a tokenizer file whose tokens never cross white space."""

    def __init__(self, path: str):
        local_env()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self._model = self.tokenizer.model
        self._pieces = _Memory(self._encode_piece)
        self._words = _Memory(self._encode_word, 3 * REMEMBERED)
        self._table = dict(enumerate(byte_characters()))
        self._lower = self._is_plain()
        added = self.tokenizer.get_added_tokens_decoder()
        self._added = {token.content: self._pack([i]) for i, token in added.items()}
        plain = all(not (t.normalized or t.lstrip or t.rstrip or t.single_word) for t in added.values())
        # the longest first, as the library takes the longest of those that start at one place
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added and plain else None
        self._by_library = bool(added) and not plain

    def _spell(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self._table)

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _is_plain(self) -> bool:
        """Whether the file normalises and cuts words as the short way in ``_encode_word`` does."""
        sample = ["Abc", "\u00c9t\u00e9,", "a.", "\u00df!"]
        normalizer, cutter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if normalizer is None or cutter is None:
            return False
        cuts = [[piece for piece, _ in cutter.pre_tokenize_str(normalizer.normalize_str(w))] for w in sample]
        return cuts == [["abc"], [self._spell("\u00e9t\u00e9"), ","], ["a", "."], [self._spell("\u00df"), "!"]]

    def _encode_piece(self, piece: str) -> bytes:
        return self._pack([t.id for t in self._model.tokenize(piece)])

    def _encode_word(self, word: str) -> bytes:
        tokenizer = self.tokenizer
        if self._lower and max(word) < "\u0250":
            # Latin letters, perhaps with a mark behind: composed already, and one match, or two
            low = word.lower()
            if low.isalpha():
                return self._pieces[self._spell(low)]
            if low[-1] in _MARKS and low[:-1].isalpha():
                return self._pieces[self._spell(low[:-1])] + self._pieces[low[-1]]
        if tokenizer.normalizer:
            word = tokenizer.normalizer.normalize_str(word)
        return b"".join(self._pieces[piece] for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(word))

    def encode_bytes(self, text: str) -> bytes:
        if self._by_library:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        # a plain search for each token is much faster than one of the pattern
        if self._cut is not None and any(map(text.__contains__, self._added)):
            return b"".join(self._added.get(part) or self._encode_plain(part) for part in self._cut.split(text))
        return self._encode_plain(text)

    def _encode_plain(self, text: str) -> bytes:
        # str.split() also splits at four control characters that aren't white space
        words = text.split() if not _CONTROLS.intersection(text) else [w for w in text.split(" ") if w]
        packed = b"".join(map(self._words.__getitem__, words))
        self._words.tidy()
        self._pieces.tidy()
        return packed


_MARKS = frozenset(".,;:!?")
_CONTROLS = frozenset("\x1c\x1d\x1e\x1f")
_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _schema(code: str, length: int) -> pa.Schema:
    kind = pa.uint16() if code == "H" else pa.uint32()
    return pa.schema([pa.field("input_ids", pa.list_(kind, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)])


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Takes ids in runs of any length, writes sequences of one length."""

    def __init__(self, fs, path: str, code: str, length: int, batch_rows: int):
        self._schema, self._length, self._rows = _schema(code, length), length, batch_rows
        self._type, self._kind = np.dtype(code), self._schema.field("input_ids").type.value_type
        self._file = fs.open_output_stream(path)
        self._writer = pa.ipc.new_file(self._file, self._schema)
        self._held = bytearray()

    def _put(self, ids: np.ndarray, real: int) -> None:
        rows = len(ids) // self._length
        mask = np.arange(len(ids)) < real
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids, self._kind), self._length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self._length),
        ]
        assert len(lists[0]) == rows
        self._writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self._schema))

    def add(self, packed: bytes) -> None:
        self._held += packed
        full = self._rows * self._length
        size = full * self._type.itemsize
        done = 0
        while len(self._held) - done >= size:
            self._put(np.frombuffer(bytes(self._held[done : done + size]), self._type), full)
            done += size
        if done:
            del self._held[:done]

    def close(self) -> None:
        if self._held:
            ids = np.frombuffer(bytes(self._held), self._type)
            self._put(np.concatenate([ids, np.zeros(-len(ids) % self._length, self._type)]), len(ids))
        self._writer.close()
        self._file.close()


class SequenceFile:
    """Random access to the sequences of one file."""

    def __init__(self, path: str):
        fs, place = file_system(path)
        self._source = pa.memory_map(place) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(place)
        self._reader = pa.ipc.open_file(self._source)
        self.length = self._reader.schema.field("input_ids").type.list_size
        self.batch_rows = self._reader.get_batch(0).num_rows if self._reader.num_record_batches else 0

    def _column(self, batch: int, name: str) -> pa.FixedSizeListArray:
        return self._reader.get_batch(batch).column(name)

    def __len__(self) -> int:
        n = self._reader.num_record_batches
        return (n - 1) * self.batch_rows + self._reader.get_batch(n - 1).num_rows if n else 0

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``k``; the ids are a view of the file."""
        batch, row = divmod(k, self.batch_rows)
        ids, mask = self._column(batch, "input_ids"), self._column(batch, "mask")
        return ids[row].values.to_numpy(), mask[row].values.to_numpy(zero_copy_only=False)

    def ids(self, start: int, count: int):
        """Views that together are ``count`` ids from ``start`` on."""
        size = self.batch_rows * self.length
        while count > 0:
            batch, at = divmod(start, size)
            view = self._column(batch, "input_ids").flatten().to_numpy()[at : at + count]
            yield view
            start, count = start + len(view), count - len(view)


def write_sequences(docs: DataFrame, path: str, end_id: int = 1, length: int = 2048, batch_rows: int = 256, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Write the files; returns a row (part, path, n_docs, n_tokens) for each part that has documents."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    fs, place = file_system(folder)
    fs.create_dir(place, recursive=True)

    def run(batches):
        encoder, name = _encoder(path), f"part-{TaskContext.get().partitionId():05d}"
        attempt = f"{TaskContext.get().taskAttemptId()}"
        fs, top = file_system(folder)
        whole, listed = f"{top}/{name}.arrow", f"{top}/{name}.docs.arrow"
        temporary = [f"{top}/.{name}.{attempt}.{i}" for i in "ab"]
        end, itemsize = encoder._pack([end_id]), np.dtype(encoder.code).itemsize
        out = index = None
        n_docs = at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = SequenceWriter(fs, temporary[0], encoder.code, length, batch_rows)
                stream = fs.open_output_stream(temporary[1])
                index = pa.ipc.new_file(stream, _DOCS)
            starts, counts = [], []
            for text in batch.column(1):
                packed = encoder.encode_bytes(text.as_py() or "") + end
                out.add(packed)
                starts.append(at)
                counts.append(len(packed) // itemsize)
                at += counts[-1]
            n_docs += batch.num_rows
            index.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=_DOCS))
        if out is not None:
            out.close()
            index.close()
            stream.close()
            for a, b in zip(temporary, (whole, listed)):
                fs.move(a, b)
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [at]})

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = narrow.repartitionByRange(spread(docs), *order[:2]).sortWithinPartitions(*order)
    return sorted(ordered.mapInArrow(run, SUMMARY).collect())


def read_documents(spark, parts: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    places, before = [], 0
    for part in parts:
        places.append((part["path"], before))
        before += part["n_tokens"]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                path, base = places[i]
                ids = SequenceFile(f"{path}.arrow")
                fs, place = file_system(f"{path}.docs.arrow")
                index = pa.ipc.open_file(fs.open_input_file(place))
                for k in range(index.num_record_batches):
                    found = index.get_batch(k)
                    starts, counts = found.column(1).to_pylist(), found.column(2).to_pylist()
                    sums = []
                    for start, count in zip(starts, counts):
                        crc = 0
                        for view in ids.ids(start, count):
                            crc = zlib.crc32(view.astype("<u4"), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [found.column(0), pa.array([base + s for s in starts], pa.int64()), found.column(2), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spark.range(0, len(places), 1, max(1, len(places))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
