"""Benchmark decontamination.

A leak is a document that an item aligns with, by Smith-Waterman over words
(match 1, mismatch and gap -1), at `threshold` of the item's words or more,
edited or not; items of fewer than `whole` words must match whole.

Seeds are pairs of neighbouring words.  An alignment of score T has T matches
more than errors, and its matches fall into one run more than there are errors
at most, so at least T - 1 neighbouring pairs of the item stand in the document.
Hence T - 2 of an item's seeds may be left aside without losing a leak: a first
pass counts the documents of every seed, and each item keeps its rarest.  A
second pass finds the kept seeds in whole documents, gathers the hits of an item
that lie near each other, checks that T - 1 of its pairs and T of its words
stand around them, and aligns the item there.  No leak above the threshold is
lost, however it was edited, and however many documents hold it.

Items are sent to the executors in blocks of at most `block_words` words each,
so what is broadcast, and the counts that come back, are bounded; the corpus is
never shuffled.  Null texts hold nothing, null or wordless items match nothing;
long texts are read whole; repeated documents are judged alike, and so are those
that share a doc_id or have none (`drop_leaks` tells them apart); of equal
scores in one document the first place counts; extra columns are ignored, empty
tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import careful, frugal, identified
from ._text import Words, code_points, slices

SEED, THRESHOLD, WHOLE, BLOCK_WORDS = 2, 0.5, 8, 1_000_000
#: Pairs of a hit and an item that shares the seed, held at once.
HITS = 1 << 20


class Items:
    """Test items: word hashes, the score that each must reach, and seeds by hash with their places."""

    def __init__(self, ids: list[int], texts: list[str], threshold: float = THRESHOLD, whole: int = WHOLE):
        if threshold * whole <= 1:
            raise ValueError("seeds of two words need a threshold of over 1 / whole")
        w = Words(pa.array(texts, pa.large_string()))
        self.ids = np.array(ids, np.int64)
        self.words = [w.hash[a:b] for a, b in zip(w.rows[:-1], w.rows[1:], strict=True)]
        self.length = np.array([len(x) for x in self.words], np.int64)
        self.need = np.where(self.length >= whole, np.ceil(threshold * self.length - 1e-9), self.length).astype(np.int64)
        grams, rows = w.shingles(SEED)
        self.grams = [grams[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
        self._seeds(grams, np.repeat(np.arange(len(ids)), np.diff(rows)), np.arange(len(grams)) - np.repeat(rows[:-1], np.diff(rows)))
        self.short = bool((self.length == 1).any())

    def _seeds(self, grams: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(grams, kind="stable")
        self.item, self.place = item[order], place[order]
        self.seed, self.at = np.unique(grams[order], return_index=True)
        self.at = np.append(self.at, len(grams))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.seed >> np.uint64(44)).astype(np.int64)] = True

    def keep_rarest(self, documents: np.ndarray) -> None:
        """Leave the most common seeds aside, as many as cost no leak; documents: how many hold each seed."""
        size = np.diff(self.at)
        grams, count = np.repeat(self.seed, size), np.repeat(documents, size)
        order = np.lexsort((self.place, count, self.item))
        item = self.item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank <= (self.length - self.need)[item]]
        self._seeds(grams[order], self.item[order], self.place[order])

    def hits(self, w: Words, grams: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word number in the batch, seed number) of all seeds in the rows, whose pairs of words are given."""
        found = []
        for g, r in [(grams, rows), *([w.shingles(1)] if self.short else [])]:
            at = np.flatnonzero(self.bits[(g >> np.uint64(44)).astype(np.int64)])
            seed = np.minimum(np.searchsorted(self.seed, g[at]), max(len(self.seed) - 1, 0))
            same = self.seed[seed] == g[at] if len(self.seed) else np.zeros(0, bool)
            at, seed = at[same], seed[same]
            row = np.searchsorted(r, at, "right") - 1
            found.append((row, at - r[row] + w.rows[row], seed))
        row, at, seed = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(row, kind="stable")
        return row[order], at[order], seed[order]


def smith_waterman(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Best local score and the end of its alignment in words; match 1, mismatch and gap -1."""
    place = np.arange(len(words) + 1, dtype=np.int32)
    above = np.zeros(len(words) + 1, np.int32)
    best, end = 0, 0
    for w in item:
        row = np.maximum(above - 1, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(words == w, 1, -1).astype(np.int32))
        above = np.maximum.accumulate(row + place) - place
        top = int(above.argmax())
        if above[top] > best:
            best, end = int(above[top]), top
    return best, end


def _leaks(w: Words, items: Items) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, end word), the best for each row and item."""
    grams, gram_rows = w.shingles(SEED)
    rows, places, seeds = items.hits(w, grams, gram_rows)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    size = np.diff(items.at)[seeds]
    before = np.append(0, np.cumsum(size))
    begin = 0
    while begin < len(rows):  # rows whole, but no more pairs of a hit and an item at once than one row or HITS
        end = max(int(np.searchsorted(before, before[begin] + HITS, "right")) - 1, begin + 1)
        end = int(np.searchsorted(rows, rows[end - 1], "right")) if end >= len(rows) or rows[end] == rows[begin] else int(np.searchsorted(rows, rows[end], "left"))
        part, n = slice(begin, end), size[begin:end]
        which = np.repeat(items.at[:-1][seeds[part]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row, at, item, place = np.repeat(rows[part], n), np.repeat(places[part], n), items.item[which], items.place[which]
        order = np.lexsort((at, item, row))
        row, at, item, place = row[order], at[order], item[order], place[order]
        far = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * items.length[item[1:]]))
        edges = np.append(np.flatnonzero(far), len(row))
        start = at - place
        lows, highs = np.minimum.reduceat(start, edges[:-1]), np.maximum.reduceat(start, edges[:-1])
        for k, a in enumerate(edges[:-1].tolist()):
            r, i = int(row[a]), int(item[a])
            m, need = int(items.length[i]), int(items.need[i])
            low, high = max(int(w.rows[r]), int(lows[k]) - (m - need)), min(int(w.rows[r + 1]), int(highs[k]) + m + (m - need))
            first = int(gram_rows[r] - w.rows[r])
            if m > 1 and np.isin(items.grams[i], grams[low + first : high - 1 + first]).sum() < need - 1:
                continue
            words = w.hash[low:high]
            if np.isin(items.words[i], words).sum() < need:  # no alignment matches more of the item's words
                continue
            score, stop = smith_waterman(items.words[i], words)
            if score >= need and score > best.get((r, i), (0,))[0]:
                _, back = smith_waterman(items.words[i][::-1], words[:stop][::-1])
                best[r, i] = (score, low + stop - back, low + stop)
        begin = end
    return [(r, i, s / len(items.words[i]), a, b) for (r, i), (s, a, b) in best.items()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, whole: int = WHOLE, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, score (share of the item's words), start and end in code points of each leak."""
    spark = docs.sparkSession
    careful(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tests = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    words = tests.agg(F.sum(F.size(F.split("t", r"\s+")))).first()[0] or 0
    blocks = -(-words // block_words)
    schema = "doc_id long, item_id long, score double, start long, end long"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        items = Items([r.i for r in rows], [r.t for r in rows], threshold, whole)
        if not len(items.seed):
            continue

        def count(batches, items=items):
            held = np.zeros(len(items.seed), np.int64)
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    w = Words(batch.column(1).slice(a, b - a))
                    row, _, seed = items.hits(w, *w.shingles(SEED))
                    held += np.bincount(np.unique(row * len(held) + seed) % len(held), minlength=len(held))
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_pydict({"seed": pa.array(some), "n": pa.array(held[some])})

        counts = base.select("doc_id", "text").mapInArrow(frugal(count), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()  # block_words rows at most
        documents = np.zeros(len(items.seed), np.int64)
        documents[counts["seed"]] = counts["n"]
        items.keep_rarest(documents)

        def run(batches, items=items):
            for batch in batches:
                for a, b in slices(batch.column(1)):
                    w = Words(batch.column(1).slice(a, b - a))
                    leaks = _leaks(w, items)
                    if leaks:
                        points = code_points(w.raw)
                        row, item, score, first, end = (np.array(x) for x in zip(*leaks, strict=True))
                        zero = points[w.offsets[row]]
                        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(row + a)), "item_id": pa.array(items.ids[item]), "score": pa.array(score), "start": pa.array(points[w.start[first]] - zero), "end": pa.array(points[w.end[end - 1]] - zero)})

        out = out.union(base.mapInArrow(frugal(run), schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that hold no item, whatever their doc_id."""
    tagged, key = identified(docs, id_col)
    leaks = find_leaks(tagged, benchmark, id_col=key, **options).select(F.col("doc_id").alias(key)).distinct()
    return tagged.join(leaks, key, "left_anti").select(docs.columns)
