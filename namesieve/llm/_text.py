"""Vectorised text primitives over Arrow buffers.

All functions work on the UTF-8 bytes of a whole batch at once.  A *word* is a
maximal run of ASCII letters and digits and of non-ASCII characters other than
Latin-1 signs and general or CJK punctuation; words compare after folding the
case of ASCII and Latin-1 letters.  Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BLOCK = 1 << 19
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values that depend on the seed alone; streams of different seeds do not overlap."""
    start = mix(np.array([(seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & _M64], np.uint64))
    step = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(step + start)


_BYTE = stream(1, 256)
_POW = np.multiply.accumulate(np.full(1024, 0x5851F42D4C957F2D, np.uint64))
_WORD = np.zeros(256, bool)
for _lo, _hi in ((48, 57), (65, 90), (97, 122), (128, 255)):
    _WORD[_lo : _hi + 1] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each text in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about `most` bytes each, one row at least."""
    _, offsets = buffers(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def code_points(raw: np.ndarray) -> np.ndarray:
    """Number of code points before each byte, and at the end."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def _fold(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes, and which of them belong to words."""
    low, word = _FOLD[raw], _WORD[raw]
    if not len(raw) or raw.max() < 0x80:
        return low, word
    before = np.empty_like(raw)
    before[0], before[1:] = 0, raw[:-1]
    upper = (before == 0xC3) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    low[upper] += 0x20
    lead = np.flatnonzero(raw == 0xC2)
    for k in (0, 1):
        word[np.minimum(lead + k, len(raw) - 1)] = False
    three = np.flatnonzero((before == 0xE2) & ((raw == 0x80) | (raw == 0x81)) | (before == 0xE3) & (raw == 0x80))
    for k in (-1, 0, 1):
        word[np.minimum(three + k, len(raw) - 1)] = False
    return low, word


class Words:
    """Words of a batch: 64-bit hash, byte range, and `rows[i]:rows[i + 1]` for the words of row i."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        self.raw, self.offsets = buffers(column)
        hashes, starts, ends = [], [], []
        at, n = 0, len(self.raw)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        while at < n:
            to = min(n, at + _BLOCK)
            while to < n and not (self.raw[to] == 32 or self.raw[to] == 10 or first[to]):
                to += 1
            low, word = _fold(self.raw[at:to])
            before = np.zeros(len(word), bool)
            before[1:] = word[:-1]
            begin = word & (~before | first[at:to])
            s = np.flatnonzero(begin)
            if len(s):
                nxt = np.append(s[1:], len(word))
                value = np.where(word, _BYTE[low], np.uint64(0))
                place = np.arange(len(word)) - np.repeat(np.append(0, s), np.diff(np.concatenate(([0], s, [len(word)]))))
                value *= _POW[place & 1023]
                if (far := np.flatnonzero(place > 1023)).size:  # long words: another odd factor for each stretch
                    value[far] *= mix(place[far] >> 10) | np.uint64(1)
                length = np.add.reduceat(word.astype(np.int64), s)
                h = np.add.reduceat(value, s) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                hashes.append(mix(h))
                starts.append(s + at)
                ends.append(np.minimum(s + length, nxt) + at)
            at = to
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hash, self.start, self.end = join(hashes, np.uint64), join(starts, np.int64), join(ends, np.int64)
        self.rows = np.searchsorted(self.start, self.offsets)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows within rows, and their row offsets; a row of 1 to n-1 words gives one shingle of all its words."""
        counts = np.diff(self.rows)
        each = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
        rows = np.concatenate(([0], np.cumsum(each)))
        start = np.repeat(self.rows[:-1] - rows[:-1], each) + np.arange(rows[-1])
        span = np.repeat(np.minimum(counts, n), each)
        out = np.zeros(len(start), np.uint64)
        factor = stream(7, n) | np.uint64(1)
        last = max(len(self.hash) - 1, 0)
        short = bool(len(span)) and int(span.min()) < n
        for k in range(n):
            term = self.hash[np.minimum(start + k, last)] * factor[k]
            out += np.where(span > k, term, np.uint64(0)) if short else term
        return mix(out + span.astype(np.uint64)), rows
