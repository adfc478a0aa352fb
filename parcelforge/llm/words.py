"""Vectorised words, word hashes and shingles over UTF-8 buffers.

Both word classes of the operators are sets of bytes: a byte of 0x80 and above
only occurs inside a non-ASCII code point, which is a word character in either
class. So words can be cut on bytes without decoding. Hashes are 64-bit
multilinear sums; two words of any corpus fall together with a chance of about
2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are tokenised at once; a longer document is taken whole.
BLOCK_BYTES = 1 << 19

_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of uint64 values."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _bytes_of(kind: str) -> np.ndarray:
    ok = np.zeros(256, bool)
    if kind == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing
        ok[0x30:0x3A] = ok[0x41:0x5B] = ok[0x61:0x7B] = ok[0x80:] = True
    else:  # [^\x20\x09-\x0D]
        ok[:] = True
        ok[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return ok


WORD_BYTES = {kind: _bytes_of(kind) for kind in ("alnum", "nonspace")}
_lower = np.arange(256, dtype=np.uint64)
_lower[0x41:0x5B] += np.uint64(32)
BYTE_CODE = splitmix(_lower + np.uint64(1 << 32))
#: Places of a word that have a multiplier of their own; further ones are these times one of their round.
ROUND = 1 << 12
_PLACE = splitmix(np.arange(ROUND, dtype=np.uint64)) | np.uint64(1)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def multipliers(place: np.ndarray, longest: int) -> np.ndarray:
    """The odd multiplier of each place in a word."""
    if longest <= ROUND:
        return _PLACE[place]
    rounds = place >> 12
    return _PLACE[place & (ROUND - 1)] * np.where(rounds == 0, np.uint64(1), splitmix(rounds.astype(np.uint64) ^ _LENGTH) | np.uint64(1))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [a, b) of about ``most`` bytes, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the n + 1 offsets of the rows among them. Long rows are read in pieces, so what is held besides the words does not grow with them."""
    if len(data) <= 2 * BLOCK_BYTES:
        return _hashes_of_piece(data, offsets, kind)
    hashes, rows = [], [0]
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        n = 0
        for h in _row_in_pieces(data[a:b], kind):
            hashes.append(h)
            n += len(h)
        rows.append(rows[-1] + n)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.array(rows, np.int64)


def _row_in_pieces(data: np.ndarray, kind: str) -> Iterator[np.ndarray]:
    """The words of one long row, piece by piece; a piece ends where a word does, and a word longer than a piece is summed up on its own."""
    ok, at = WORD_BYTES[kind], 0
    while at < len(data):
        end = min(at + BLOCK_BYTES, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~ok[data[at:end]])
            if not len(gaps):
                total, begin = 0, at
                while at < len(data):
                    piece = data[at : at + BLOCK_BYTES]
                    gaps = np.flatnonzero(~ok[piece])
                    piece = piece[: gaps[0]] if len(gaps) else piece
                    place = np.arange(at - begin, at - begin + len(piece))
                    total = (total + int((BYTE_CODE[piece] * multipliers(place, len(data))).sum(dtype=np.uint64))) & _MASK
                    at += len(piece)
                    if len(gaps):
                        break
                yield splitmix(np.array([total], np.uint64) + np.array([at - begin], np.uint64) * _LENGTH)
                continue
            end = at + int(gaps[-1]) + 1
        yield _hashes_of_piece(data[at:end], np.array([0, end - at], np.int64), kind)[0]
        at = end


def _hashes_of_piece(data: np.ndarray, offsets: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = WORD_BYTES[kind][data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.flatnonzero(word & ~after) + 1 - starts
    at = np.flatnonzero(word)
    first = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    place = np.arange(len(at)) - np.repeat(first, lengths)
    codes = BYTE_CODE[data[at]] * multipliers(place, int(lengths.max()))
    hashes = np.add.reduceat(codes, first) + lengths.astype(np.uint64) * _LENGTH
    return splitmix(hashes), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct k-word shingles; with fewer words the whole sequence as one, without words none."""
    n = len(words)
    mixed = np.zeros(n, np.uint64)
    if n >= k:
        whole = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            whole = splitmix(whole ^ words[j : n - k + 1 + j])
        mixed[: n - k + 1] = whole
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(mixed[a : b - k + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            h = np.array([b - a], np.uint64)
            for j in range(a, b):
                h = splitmix(h * np.uint64(0xA24BAED4963EE407) ^ words[j])
            s = h
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out
