"""Token ids of whole texts by a public tokenizer, cached by unit.

Both supported kinds of tokenizer (byte-level BPE, and BPE with word ends that
drops white space) split a text by a pattern before merging, so a piece of text
between two certain boundaries of that pattern has the same ids wherever it
stands.  A batch is cut at boundaries that are certain from the neighbouring
characters alone, and the library encodes each distinct unit that it has not
met yet.  Cuts are made only between characters of which both are in a class
that this module knows (ASCII, Latin letters, Cyrillic letters); beside others
nothing is cut, which costs time and no correctness.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._text import buffers, slices

CACHE = 400_000
#: Bytes of text encoded at once.
BLOCK = 4 << 20
#: Classes of bytes: other, letter, punctuation, digit, blank or line feed.
_X, _L, _P, _N, _W = range(5)
_CLASS = np.zeros(256, np.uint8)
_CLASS[[*range(65, 91), *range(97, 123)]] = _L
_CLASS[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x != 0x27]] = _P
_CLASS[48:58] = _N
_CLASS[[10, 32]] = _W
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32


def _classes(raw: np.ndarray) -> np.ndarray:
    kind = _CLASS[raw]
    if raw.max() >= 0x80:
        lead = np.flatnonzero((raw == 0xC3) | (raw == 0xC4) | (raw == 0xC5) | (raw == 0xD0) | (raw == 0xD1))
        lead = lead[lead + 1 < len(raw)]
        a, b = raw[lead], raw[lead + 1]
        odd = (a == 0xC3) & ((b == 0x97) | (b == 0xB7)) | (a == 0xC4) & (b == 0xB0)
        lead = lead[~odd & (b >= 0x80) & (b <= 0xBF)]
        kind[lead], kind[lead + 1] = _L, _L
    return kind


class Encoder:
    """encode(column) -> (ids of all rows, row offsets); about `cache` units, and eight times as many ids, are kept between calls."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory of their own
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        spec = json.loads(self.tokenizer.to_str())
        self.word_ends = spec["model"].get("end_of_word_suffix") or ""
        self.lower = self.word_ends != ""
        self.special = {t["content"] for t in spec["added_tokens"]}
        size = max(vocab.values()) + 1
        self.width, self.closes = np.zeros(size, np.int64), np.zeros(size, bool)
        for token, i in vocab.items():
            self.width[i], self.closes[i] = len(token), bool(self.word_ends) and token.endswith(self.word_ends)
        self.cuts = np.zeros(64, bool)
        self.cuts[[x << 3 | y for x, y in ((_L, _P), (_P, _L), (_L, _W), (_P, _W), (_N, _W))]] = True
        if self.lower:  # white space is dropped, and capitals are as good as small letters
            self.cuts[[_W << 3 | y for y in (_L, _P, _N)]] = True
        self.limit = cache
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def _keep(self, units: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        start = int(self.ends[-1])
        stop = start + len(ids)
        if stop > len(self.ids):
            self.ids = np.concatenate((self.ids[:start], np.zeros(max(stop, 2 * len(self.ids)) - start, np.uint32)))
        self.ids[start:stop] = ids
        self.known.update(zip(units, range(len(self.known), len(self.known) + len(units)), strict=True))
        self.ends = np.concatenate((self.ends, start + ends))

    def _learn(self, new: list[str]) -> None:
        """Encode new units: those of letters alone in long runs, whose ends show in the ids, the others one by one."""
        if self.word_ends:
            plain, glue = [u for u in new if u.isalpha()], " "
        else:
            plain, glue = [u for u in new if u[0] == " " and u[1:].isalpha()], ""
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            runs = [glue.join(some[k : k + 500]) for k in range(0, len(some), 500)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)])
            if self.word_ends:
                ends = np.flatnonzero(self.closes[ids]) + 1
            else:
                bytes_ = np.cumsum(np.fromiter(map(len, map(str.encode, some)), np.int64, len(some)))
                reached = np.cumsum(self.width[ids])
                ends = np.searchsorted(reached, bytes_) + 1
                if len(ids) and not np.array_equal(reached[ends - 1], bytes_):
                    ends = ends[:0]
            if len(ends) == len(some) and (not len(ends) or ends[-1] == len(ids)):
                self._keep(some, ids, ends)
        rest = [u for u in new if u not in self.known]
        for at in range(0, len(rest), 10_000):
            some = rest[at : at + 10_000]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self._keep(some, np.fromiter((i for ids in found for i in ids), np.uint32, int(lengths.sum())), np.cumsum(lengths))

    def _places(self, units: list[str]) -> np.ndarray:
        if len(self.known) > self.limit or self.ends[-1] > 8 * self.limit:
            self._reset()
        found = list(map(self.known.get, units))
        if None in found:
            self._learn([u for u, i in zip(units, found, strict=True) if i is None])
            found = map(self.known.__getitem__, units)
        return np.fromiter(found, np.int32, len(units))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = buffers(column)
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        kind = _classes(raw)
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = self.cuts[(kind[:-1] << 3) | kind[1:]]
        if self.lower:
            raw, given = _SMALL[raw], raw
        for token in self.special:  # stays whole, and with the capitals that keep a text from being it
            whole, mark = raw.tobytes(), token.encode()
            at = whole.find(mark)
            while at >= 0:
                cut[at + 1 : at + len(mark)] = False
                if self.lower:
                    raw[at : at + len(mark)] = given[at : at + len(mark)]
                at = whole.find(mark, at + 1)
        cut[offsets] = True
        cuts = np.flatnonzero(cut)
        del kind, cut
        units = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = pc.dictionary_encode(units)
        at = self._places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        del units, coded
        ends = self.ends.astype(np.int32)
        start = ends[at]
        length = ends[at + 1] - start
        del at
        done = np.zeros(len(length) + 1, np.int64)
        np.cumsum(length, out=done[1:])
        where = np.repeat(start - done[:-1].astype(np.int32), length)
        where += np.arange(len(where), dtype=np.int32)
        return self.ids[where], done[np.searchsorted(cuts, offsets)]

    def documents(self, column: pa.Array | pa.ChunkedArray, end_id: int | None):
        """For blocks of rows: first row, ids with the end id after each row, row offsets."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        for a, b in slices(column, BLOCK):
            ids, rows = self.encode(column.slice(a, b - a))
            if end_id is not None:
                ids = np.insert(ids, rows[1:], np.uint32(end_id))
                rows = rows + np.arange(len(rows))
            yield a, ids, rows


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this process, which tasks that follow each other share."""
    return Encoder(path)
