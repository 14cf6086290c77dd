"""Words of whole texts as arrays: where they start, how long they are, which row and place they have.

A word is a run of digits, letters a-z (A-Z lower-cased) and bytes from 0x80 on.
Texts are taken in pieces of a few MB, so that what a task holds doesn't follow
the size of a batch; a longer text is cut between words, and the pieces after
the first begin with the last words of the one before, for runs that cross.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 4 << 20
ROOM = 16  # zero bytes after a piece, so that fixed widths can be read at any place

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True


@dataclass
class Piece:
    low: np.ndarray  # bytes, lower-cased, with ROOM zeros behind
    start: np.ndarray  # of each word, in ``low``
    length: np.ndarray
    row: np.ndarray  # of each word, in the batch
    place: np.ndarray  # of each word, among those of its row
    new: int  # the words before this one were in the piece before


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and the last ends; nulls are empty."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=kind)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return held, at.astype(np.int64)


def _word_end(held: np.ndarray, at: int, end: int) -> int:
    """The first place from ``at`` on that isn't within a word."""
    while at < end:
        out = np.flatnonzero(~_IN_WORD[held[at : min(end, at + 65536)]])
        if len(out):
            return at + int(out[0])
        at = min(end, at + 65536)
    return end


def _split(held: np.ndarray, at: np.ndarray, first: int) -> Piece:
    """The words of the texts between the places ``at``; ``first``: number of the first of them."""
    low = np.zeros(at[-1] - at[0] + ROOM, dtype=np.uint8)
    low[:-ROOM] = _LOWER[held[at[0] : at[-1]]]
    inside = _IN_WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[at - at[0]] = True
    after = np.concatenate(([False], inside[:-1]))
    start = np.flatnonzero(inside & (~after | edge[:-1]))
    before = np.concatenate((inside[1:], [False]))
    length = np.flatnonzero(inside & (~before | edge[1:])) + 1 - start
    row = np.searchsorted(at - at[0], start, side="right") - 1
    place = np.arange(len(start)) - np.searchsorted(row, row, side="left")
    return Piece(low, start, length, (row + first).astype(np.int32), place, 0)


def pieces(texts: pa.Array, overlap: int = 0, most: int = PIECE):
    """Pieces of the texts in order, with ``overlap`` words of a long text's piece before."""
    held, at = _bytes(texts)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        if upto > row + 1 or at[upto] - at[row] <= most:
            yield _split(held, at[row : upto + 1], row)
            row = upto
            continue
        begin, end, known, seen = int(at[row]), int(at[row + 1]), 0, 0
        fresh = begin  # where the words not yet seen begin
        while fresh < end:
            stop = _word_end(held, min(end, fresh + most), end)
            piece = _split(held, np.array([begin, stop]), row)
            piece.new = known
            piece.place = piece.place + (seen - known)
            yield piece
            seen += len(piece.start) - known
            known = min(overlap, len(piece.start))
            begin = begin + int(piece.start[-known]) if known else stop
            fresh = stop
        row += 1


# --- fixed-width keys ----------------------------------------------------------

KEY_BYTES = 16
_MASK = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def keys(low: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's first and second eight bytes as numbers; they tell words of ``KEY_BYTES`` at most apart."""
    eight = np.ndarray(len(low) - 7, dtype="<u8", buffer=low, strides=(1,))
    one = eight[start] & _MASK[np.minimum(length, 8)]
    two = eight[np.minimum(start + 8, len(eight) - 1)] & _MASK[np.clip(length - 8, 0, 8)]
    return one, two


# --- checksums -----------------------------------------------------------------


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (c >> 1)
    return c.astype(np.uint32)


STEP = _table()
NEAR = 32


def _spread(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A linear map given by what it makes of each of the four bytes."""
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Maps of a checksum over 0 to NEAR - 1 further zero bytes, and over NEAR times the powers of two."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    near = []
    for _ in range(NEAR):
        near.append(now)
        now = STEP[now & 255] ^ (now >> 8)
    far = []
    for _ in range(26):
        far.append(now)
        now = _spread(now, now)
    return np.stack(near), np.stack(far)


_SHIFT, _FAR = _shifts()
_FLAT = _SHIFT.reshape(-1)


def shifted(c: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a checksum turns into when ``length`` bytes follow, but for those bytes' own checksum."""
    base = (length & (NEAR - 1)).astype(np.int64) * 1024
    out = _FLAT[base + (c & 255)] ^ _FLAT[base + 256 + ((c >> 8) & 255)] ^ _FLAT[base + 512 + ((c >> 16) & 255)] ^ _FLAT[base + 768 + (c >> 24)]
    long = np.flatnonzero(length >= NEAR)
    rest = length[long] // NEAR
    for power in range(len(_FAR)):
        if not len(long):
            break
        odd = (rest & 1).astype(bool)
        out[long[odd]] = _spread(_FAR[power], out[long[odd]])
        rest >>= 1
        long, rest = long[rest > 0], rest[rest > 0]
    return out


def spaced(c: np.ndarray) -> np.ndarray:
    """The checksum after one further space."""
    c = ~c
    return ~(STEP[(c & 255) ^ 32] ^ (c >> 8))


def checksums(piece: Piece) -> np.ndarray:
    """crc32 of every word."""
    import zlib

    out = np.zeros(len(piece.start), dtype=np.uint32)
    if not len(out):
        return out
    short = np.minimum(piece.length, NEAR + 1).astype(np.uint8)
    order = np.argsort(NEAR + 1 - short, kind="stable")
    counts = np.cumsum(np.bincount(short, minlength=NEAR + 2)[::-1])[::-1]  # words of so many bytes at least
    start = piece.start[order]
    c = np.full(len(out), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(NEAR):
        m = counts[i + 1]
        if not m:
            break
        head = c[:m]
        c[:m] = STEP[(head ^ piece.low[start[:m] + i]) & 255] ^ (head >> 8)
    out[order] = ~c
    for i in np.flatnonzero(piece.length > NEAR):
        s = piece.start[i]
        out[i] = zlib.crc32(piece.low[s : s + piece.length[i]])
    return out


def run_checksums(piece: Piece, longest: int):
    """(rows, crc32) of all runs of 1 to ``longest`` words that end in a new word of the piece, words joined by a space."""
    one = checksums(piece)
    yield piece.row[piece.new :], one[piece.new :]
    run = one
    for n in range(2, longest + 1):
        # run[i]: the words i to i + n - 2; it grows by word i + n - 1
        if len(run) < 2:
            return
        run = shifted(spaced(run[:-1]), piece.length[n - 1 :]) ^ one[n - 1 :]
        whole = piece.row[n - 1 :] == piece.row[: len(run)]
        whole[: max(0, piece.new - n + 1)] = False
        yield piece.row[n - 1 :][whole], run[whole]
