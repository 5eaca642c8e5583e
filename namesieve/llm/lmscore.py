"""Stupid-backoff language-model scores, each document against all others.

Documents are dealt into chunks.  The count table is partitioned by n-gram hash:
each chunk's n-grams meet those of all others there, are summed, and come back
to the chunk (`_counts`), where they are joined to the n-grams of its documents;
each document's own occurrences are taken off, and the logarithms summed.

    S(w | context) = c(context w) / c(context)         if c(context w) > 0
                     `backoff` S(w | shorter context)  else; a text's first
                     words are scored with the context there is
    S(w) = c(w) / N, and `backoff` / (N + 1) for a word that no other document has

All counts leave the document itself out; N is the number of words of all
other documents.  score: mean natural logarithm of S over the words.

N-grams travel as sorted blocks of hashes, not as a row each: a row an n-gram of
each order is several times the input on disk.

A document without words (null or empty text) has n_words 0 and a null score;
rows that share a doc_id, or repeat, are scored as documents of their own; a
very long text is one row of its chunk; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _counts
from ._spark import careful, identified, tidy
from ._text import Words, mix

ORDER, BACKOFF = 3, 0.4
_ALL = np.uint64(0)  # the entry that counts all words


class Grams:
    """n-grams of 1 to `order` words of a batch: for each order the hash at each word, 0 where the row has too few words before it."""

    def __init__(self, column: pa.Array, order: int):
        w = Words(column)
        self.rows, long = w.rows, w.hash
        place = np.arange(len(w.hash)) - np.repeat(w.rows[:-1], np.diff(w.rows))
        self.by_order = [_counts.short(long)]
        for n in range(2, order + 1):
            before = np.append(np.uint64(0), long[:-1])[: len(long)]
            long = np.where(place >= n - 1, mix(before * np.uint64(0x9E3779B97F4A7C15) + w.hash + np.uint64(n)), np.uint64(0))
            self.by_order.append(_counts.short(long))

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams of all orders in the order of their hashes, and their counts; the first counts all words."""
        h = np.concatenate([x[x > 0] for x in self.by_order])
        h, n = np.unique(h, return_counts=True)
        return np.append(_ALL, h), np.append(len(self.by_order[0]), n)


def _others(grams: Grams, shared: pa.Table) -> tuple[list[np.ndarray], int]:
    """For each order, how often the n-gram at each word occurs in other documents; and the number of all words.

    One sort of all n-grams of the chunk finds both counts: looking each up is several times as slow.
    """
    size, n_words = np.diff(grams.rows), len(grams.by_order[0])
    x = np.concatenate(grams.by_order)
    at = np.argsort(x)
    x = x[at]
    new = np.append(True, x[1:] != x[:-1])[: len(x)]
    none = int(len(x) > 0 and x[0] == 0)  # the first run stands for words that have no n-gram
    del x
    times = np.diff(np.append(np.flatnonzero(new), len(at)))
    total = _counts.totals(shared, np.append(n_words, times[none:]))
    # the sort need not be stable: places go up within a run of equal n-grams once both are sorted as one number
    key = np.cumsum(new)
    key -= 1
    key <<= 32
    key |= at
    key.sort()
    at = key & 0xFFFFFFFF
    row = np.tile(np.repeat(np.arange(len(size), dtype=np.int32), size), len(grams.by_order))[at]
    new[1:] |= row[1:] != row[:-1]
    del row
    own = np.diff(np.append(np.flatnonzero(new), len(at)))
    key >>= 32
    key += 1 - none
    others = total[key]
    others -= np.repeat(own, own)
    if none:
        others[: times[0]] = 0
    key[at] = others
    return np.split(key, len(grams.by_order)), int(total[0])


def _scores(grams: Grams, others: list[np.ndarray], rest: np.ndarray, backoff: float) -> np.ndarray:
    """S of each word; others: counts of the n-grams at each word in other documents, rest: the words of these, by order."""
    first = grams.by_order[0]
    s = np.where(others[0] > 0, others[0] / np.maximum(rest, 1), backoff / (rest + 1.0))
    for k in range(1, len(others)):
        context = np.append(0, others[k - 1][:-1])[: len(first)]
        lower = np.where(grams.by_order[k] > 0, backoff, 1.0) * s  # a row's first words have no longer context to back off from
        s = np.where(others[k] > 0, others[k] / np.maximum(context, 1), lower)
    return s


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, chunk_chars: int = _counts.CHUNK_CHARS, bucket_ngrams: int = _counts.BUCKET_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score."""
    careful(docs.sparkSession)
    chars = docs.agg(F.sum(F.length(text_col)).alias("chars")).first().chars or 0
    chunks, buckets = _counts.grid(chars, chars * order // 6, chunk_chars, bucket_ngrams)
    tagged, key = identified(docs, id_col)  # repeated rows are dealt apart too
    dealt = tagged.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk"))

    def count(table: pa.Table) -> pa.Table:
        tidy()
        h, n = Grams(table["text"].combine_chunks(), order).distinct()
        return _counts.cells(h, n, table["chunk"][0].as_py(), buckets)

    def score(table: pa.Table, shared: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        tidy()
        grams = Grams(table["text"].combine_chunks(), order)
        others, n_words = _others(grams, shared)
        size = np.diff(grams.rows)
        rest = np.repeat(n_words - size, size)  # words of the other documents
        sums = np.zeros(len(size))
        full = size > 0
        if full.any():
            sums[full] = np.add.reduceat(np.log(_scores(grams, others, rest, backoff)), grams.rows[:-1][full])
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(size), "score": pa.array(sums / np.maximum(size, 1), mask=~full)})

    dealt = _counts.apart(dealt, "chunk", chunks)
    counted = dealt.groupBy("chunk").applyInArrow(count, _counts.CELLS)
    shared = _counts.apart(counted, "bucket", buckets).groupBy("bucket").applyInArrow(_counts.add, _counts.SHARED)
    return dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(score, "doc_id long, n_words long, score double")
