"""Vectorised words of many texts at once: byte classes, word hashes, shingles.

Texts stay the bytes of an Arrow column; no Python string is made per word.  A
word's hash is a polynomial over random 64-bit values of its bytes, computed from
prefix sums, so it depends on the word alone and not on its place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; bounds the temporary arrays.
SEGMENT = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)
_MIX_1, _MIX_2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_STEP = np.uint64(int(_rng.integers(0, 2**63, dtype=np.uint64)) * 2 + 1)

#: Lower case of A-Z only; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words that white space ends: all but space and 0x09-0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of digits, letters and all non-ASCII characters, after ``LOWER``.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SEGMENT, 1 << (length - 1).bit_length())
    if size not in _powers:
        tables = []
        for base in (_BASE, _INVERSE):
            out = np.empty(size, np.uint64)
            out[0] = 1
            have = 1
            while have < size:
                out[have : 2 * have] = out[:have] * np.uint64(pow(base, have, 2**64))
                have *= 2
            tables.append(out)
        if size > SEGMENT:  # a word longer than a segment; not kept
            return tables[0], tables[1]
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * _MIX_1
    x ^= x >> np.uint64(33)
    x *= _MIX_2
    x ^= x >> np.uint64(33)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows (one more than rows); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of a batch of texts.

    ``hash`` has a value per word, in order; ``first[i]:first[i + 1]`` are the
    words of text i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        self.rows = len(offsets) - 1
        hashes, starts = [], []
        begin, total = 0, len(data)
        edges = offsets[1:-1]
        while begin < total:
            end = min(total, begin + SEGMENT)
            if end < total:
                end = self._cut(data, edges, inside, end)
            h, s = self._segment(data[begin:end], offsets, begin, end, inside)
            hashes.append(h)
            starts.append(s)
            begin = end
        self.hash = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        self.first = np.searchsorted(start, offsets)

    @staticmethod
    def _cut(data, edges, inside, end):
        """The first place from ``end`` where no word continues."""
        nearest = np.searchsorted(edges, end)
        stop = edges[nearest] if nearest < len(edges) else len(data)
        while end < stop:
            piece = inside[data[end - 1 : min(stop, end + 4096)]]
            out = np.flatnonzero(~piece)
            if len(out):
                return end + max(0, int(out[0]))
            end = min(stop, end + 4096)
        return int(stop)

    @staticmethod
    def _segment(raw, offsets, begin, end, inside):
        data = LOWER[raw]
        word = inside[data]
        before = np.empty(len(word), bool)
        before[0] = False
        before[1:] = word[:-1]
        after = np.empty(len(word), bool)
        after[-1] = False
        after[:-1] = word[1:]
        low, high = np.searchsorted(offsets, [begin, end])
        edges = offsets[low:high] - begin
        edges = edges[(edges > 0) & (edges < len(word))]
        before[edges] = False
        after[edges - 1] = False
        starts = np.flatnonzero(word & ~before)
        ends = np.flatnonzero(word & ~after) + 1
        power, inverse = _power_tables(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * power[: len(data)], out=sums[1:])
        return mix64((sums[ends] - sums[starts]) * inverse[starts]), starts + begin

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.rows), self.counts())


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, also over the ends of texts; position i starts at word i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out *= _STEP
        out += hashes[k : k + n]
    return mix64(out)


def grams_at(hashes: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Hashes, as ``grams`` has them, of the runs of ``size`` words that begin at ``begin``."""
    out = np.full(len(begin), np.uint64(size), np.uint64)
    for k in range(size):
        out *= _STEP
        out += hashes[begin + k]
    return mix64(out)
