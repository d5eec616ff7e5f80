"""Words, word hashes and shingles of whole text columns, as numpy arrays over Arrow's own bytes.

Texts are never cut short: a text longer than a piece is hashed in pieces that end between words.
All hashes are 64 bits wide; two different words or shingles are taken to differ in their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def between_spaces() -> np.ndarray:
    """True for the bytes of words [^\\x20\\x09-\\x0D]+."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    return table


def letters_and_digits() -> np.ndarray:
    """True for the bytes of words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, and for A-Z, which are lower-cased first."""
    table = np.zeros(256, bool)
    for first, last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = True
    return table


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, end) that hold at most `limit` bytes, or a single longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), rows)
        yield first, end
        first = end


class WordHasher:
    """Hashes the words of texts, A-Z lower-cased; made once per task.

    With `prefixes`, rows of hashes follow for the first so many bytes of each word (shorter words: the word itself).
    """

    def __init__(self, word_bytes: np.ndarray, limit: int = PIECE, prefixes: tuple[int, ...] = ()):
        self.word_bytes, self.limit, self.prefixes = word_bytes, limit, prefixes
        fold = np.arange(256)
        fold[0x41:0x5B] += 0x20
        self.values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[fold]
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        base = 0x5851F42D4C957F2D
        inverse = pow(base, -1, 1 << 64)
        for name, factor in (("up", base), ("down", inverse)):
            powers = np.full(n, factor, np.uint64)
            powers[0] = 1
            setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n > len(self.up):
            self._powers(1 << int(n - 1).bit_length())
        inside = self.word_bytes[data]
        opens, closes = inside.copy(), inside.copy()
        starts = offsets[:-1][offsets[:-1] < n]
        opens[1:] &= ~inside[:-1]
        opens[starts] = inside[starts]
        closes[:-1] &= ~inside[1:]
        ends = offsets[1:][offsets[1:] > 0] - 1
        closes[ends] = inside[ends]
        opens, closes = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[:n], out=total[1:])
        words = mixed((total[closes] - total[opens]) * self.down[opens])
        if self.prefixes:
            cut = [mixed((total[np.minimum(closes, opens + n)] - total[opens]) * self.down[opens] + np.uint64(n)) for n in self.prefixes]
            words = np.stack([words, *cut])
        return words, np.searchsorted(opens, offsets)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """The words of one text, in pieces that end between words."""
        found, at = [], 0
        while at < len(data):
            end = min(at + self.limit, len(data))
            while end < len(data):
                gaps = np.flatnonzero(~self.word_bytes[data[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                    break
                end = min(end + self.limit, len(data))  # a word longer than a piece
            found.append(self._piece(data[at:end], np.array([0, end - at]))[0])
            at = end
        return np.concatenate(found, -1) if found else np.zeros(0, np.uint64)

    def runs(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per run of rows: its first row, the word hashes, and where each row's words begin (one more at the end)."""
        data, offsets = texts_of(column)
        for first, end in pieces(offsets, self.limit):
            own = data[offsets[first] : offsets[end]]
            if end == first + 1 and len(own) > self.limit:
                words = self._long(own)
                yield first, words, np.array([0, words.shape[-1]])
            else:
                yield first, *self._piece(own, offsets[first : end + 1] - offsets[first])

    def rows(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The word hashes of every row, in order."""
        for _, words, bounds in self.runs(column):
            for i in range(len(bounds) - 1):
                yield words[bounds[i] : bounds[i + 1]]


def shingled(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` words, in order; fewer words: one hash of them all; none: none."""
    if not len(words):
        return words
    if len(words) < size:
        size = len(words)
    found = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        found = mixed(found * np.uint64(0x9FB21C651E98DF25) + words[i : len(words) - size + 1 + i])
    return found
