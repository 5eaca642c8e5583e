"""SimHash fingerprints, linked over a hierarchical index in Gray order.

Fingerprints are sorted by Gray rank and cut into blocks.  In a block, and
over the roots of all blocks, every FAN neighbours get a node above them that
takes over the bits they all share; what stays below is the rest.  A search
goes down from the root, adds up the differences on the bits of each node and
leaves a whole group as soon as there are too many.  No bit is ever compared
twice, and no pair of fingerprints is compared whose groups differ too much.

The upper tree (roots of blocks, at most about MOST_BLOCKS of them, whatever
the corpus) says which blocks a fingerprint may have links in; it is sent
there once.  A block's task yields a spanning forest of the links it finds,
not the links, and components are found over forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import careful, components, frugal, slots, spread_join, written
from ._text import buffers, slices

FAN = 16
BLOCK = 4096
MOST_BLOCKS = 1 << 16
#: Searches hold at most so many pairs of a fingerprint and a node at once.
FRONTIER = 1 << 18
#: Blocks of queries that one copy of a block meets.
MEETS = 32

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


def shingle_hashes(column: pa.Array, n: int = 3, seed: int = 42, piece: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, XXH64) of all n-word shingles, in pieces; words are runs of other bytes than ASCII white space, A-Z lower-cased, joined by one space; a row of fewer words gives them all."""
    raw, offsets = buffers(column)
    space = (raw == 32) | ((raw - np.uint8(9)) < 5)
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges], after[edges - 1] = True, True
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    keep = ~space
    keep[end[end < len(raw)]] = True  # one space behind each word
    place = np.cumsum(keep)
    text = np.where(space, np.uint8(32), _LOW[raw])[keep].tobytes()
    rows = np.searchsorted(start, offsets)
    start, end = place[start] - 1, place[end - 1]
    counts = np.diff(rows)
    each = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    row = np.repeat(np.arange(len(counts)), each)
    first = np.repeat(rows[:-1] - (np.cumsum(each) - each), each) + np.arange(len(row))
    last = first + np.repeat(np.minimum(counts, n), each) - 1
    h = xxhash.xxh64_intdigest
    for at in range(0, len(row), piece):
        here = slice(at, at + piece)
        yield row[here], np.fromiter((h(text[s:e], seed) for s, e in zip(start[first[here]].tolist(), end[last[here]].tolist())), np.uint64)


def simhash(column: pa.Array) -> np.ndarray:
    """One 64-bit fingerprint a row: bit i is set in more than half of its shingles' hashes."""
    n = len(column)
    ones, total = np.zeros((n, 64), np.int64), np.zeros(n, np.int64)
    for row, h in shingle_hashes(column):
        at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones[row[at]] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        total[row[at]] += np.diff(np.append(at, len(row)))
    return np.packbits(2 * ones > total[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order in which neighbours differ by one bit."""
    rank = codes.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Patterns (mask, value) in Gray order under nodes of shared bits; full codes have all bits in their masks."""

    def __init__(self, value: np.ndarray, mask: np.ndarray | None = None):
        value = value.astype(np.uint64)
        mask = np.full(len(value), ~np.uint64(0)) if mask is None else mask.astype(np.uint64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from the leaves up: value, and mask without what nodes above hold
        while True:
            if len(value) <= 1:
                self.levels.append((value, mask))
                break
            at = np.arange(0, len(value), FAN)
            every, some = np.bitwise_and.reduceat(value, at), np.bitwise_or.reduceat(value, at)
            shared = np.bitwise_and.reduceat(mask, at) & ~(every ^ some)
            self.levels.append((value, mask & ~np.repeat(shared, FAN)[: len(value)]))
            value, mask = every & shared, shared

    @property
    def root(self) -> tuple[int, int]:
        value, mask = self.levels[-1]
        return int(value[0]), int(mask[0])

    def search(self, queries: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) positions that differ in `most` bits or fewer of the leaf's mask, in pieces."""
        top = len(self.levels) - 1
        if not len(queries) or not len(self.levels[0][0]):
            return
        value, mask = self.levels[top]
        sums = np.bitwise_count((queries ^ value[0]) & mask[0])
        q = np.flatnonzero(sums <= most)
        todo = [(top, q, np.zeros(len(q), np.int64), sums[q])]
        while todo:
            level, q, node, sums = todo.pop()
            if not level:
                yield q, node
                continue
            if len(q) * FAN > FRONTIER and len(q) > 1:
                half = len(q) // 2
                todo += [(level, q[half:], node[half:], sums[half:]), (level, q[:half], node[:half], sums[:half])]
                continue
            value, mask = self.levels[level - 1]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            there = child < len(value)
            child, q, sums = child[there], np.repeat(q, FAN)[there], np.repeat(sums, FAN)[there]
            sums = sums + np.bitwise_count((queries[q] ^ value[child]) & mask[child])
            near = sums <= most
            todo.append((level - 1, q[near], child[near], sums[near]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least node that links join each of n nodes to."""
    least = np.arange(n)
    for a, b in links:
        while True:
            a, b = least[a], least[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := least[least], least):
                least = up
    return least


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, to in slices(b.column(1), 1 << 20):
            codes = simhash(b.column(1).slice(at, to - at))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), pa.array(codes.view(np.int64)), pa.array((gray_rank(codes) ^ np.uint64(1 << 63)).view(np.int64))], ["doc_id", "code", "rank"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, code, rank) of every row; rank is the Gray rank, as a signed number of the same order. A null text is empty, and has the code 0."""
    careful(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(frugal(_fingerprints), "doc_id long, code long, rank long")


def _blocks(size: int):
    def cut(batches):
        from pyspark import TaskContext

        block, held = TaskContext.get().partitionId() << 32, np.zeros(0, np.uint64)

        def out(codes):
            value, mask = GrayIndex(codes).root
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array(np.array([mask, value], np.uint64).view(np.int64)[:1]), pa.array(np.array([mask, value], np.uint64).view(np.int64)[1:]), pa.array([codes.tobytes()], pa.binary())], ["block", "mask", "value", "codes"])

        for b in batches:
            held = np.concatenate((held, np.asarray(b.column(0)).view(np.uint64)))
            while len(held) >= size:
                yield out(held[:size])
                block, held = block + 1, held[size:]
        if len(held):
            yield out(held)

    return cut


def _route(blocks: np.ndarray, masks: np.ndarray, values: np.ndarray, most: int):
    def run(batches):
        upper = GrayIndex(values, masks)
        for b in batches:
            for block, codes in zip(b.column(0).to_pylist(), b.column(3)):
                codes = np.frombuffer(codes.as_buffer(), np.uint64)
                found = [np.zeros((2, 0), np.int64), *(np.stack(x) for x in upper.search(codes, most))]
                q, to = np.concatenate(found, axis=1)
                q, to = q[blocks[to] >= block], to[blocks[to] >= block]  # each pair of blocks once
                order = np.argsort(to, kind="stable")
                q, to = q[order], to[order]
                at = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
                for s, e in zip(at.tolist(), [*at[1:].tolist(), len(to)]):
                    yield pa.RecordBatch.from_arrays([pa.array([int(blocks[to[s]])]), pa.array([block]), pa.array([codes[q[s:e]].tobytes()], pa.binary())], ["block", "origin", "queries"])

    return run


def _meet(most: int):
    def run(batches):
        known, index, codes = None, None, None
        for b in batches:
            for block, leaves, queries in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if block != known:
                    codes = np.frombuffer(leaves.as_py(), np.uint64)
                    known, index = block, GrayIndex(codes)
                asked = np.frombuffer(queries.as_buffer(), np.uint64)
                n = len(codes)
                least = forest(n + len(asked), ((leaf, n + q) for q, leaf in index.search(asked, most)))
                both = np.concatenate((codes, asked)).view(np.int64)
                a, z = both, both[least]
                joined = a != z
                yield pa.RecordBatch.from_arrays([pa.array(a[joined]), pa.array(z[joined])], ["a", "b"])

    return run


def links(codes: DataFrame, most: int = 2, block: int = BLOCK) -> DataFrame:
    """(a, b): a spanning forest of all links between the distinct codes (columns code, rank) that differ in `most` bits or fewer."""
    spark = codes.sparkSession
    n = codes.count()
    size = max(block, -(-n // MOST_BLOCKS))
    parts = min(max(1, n // (4 * size)), 10_000)
    table = written(codes.repartitionByRange(parts, "rank").sortWithinPartitions("rank").select("code").mapInArrow(_blocks(size), "block long, mask long, value long, codes binary"))
    roots = table.select("block", "mask", "value").orderBy("block").toPandas()  # at most MOST_BLOCKS and one more a partition
    arrays = [roots[c].to_numpy(np.int64) for c in roots]
    routed = written(table.repartition(slots(spark), "block").mapInArrow(_route(arrays[0], arrays[1].view(np.uint64), arrays[2].view(np.uint64), most), "block long, origin long, queries binary"))
    load = F.broadcast(routed.groupBy("block").agg(F.ceil(F.count("*") / MEETS).alias("copies")))  # no more rows than the roots
    asked = routed.join(load, "block").withColumn("copy", F.pmod(F.xxhash64("origin"), "copies"))
    copies = table.join(load, "block").select("block", "codes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    met = copies.join(asked, ["block", "copy"]).select("block", "codes", "queries")
    return met.mapInArrow(_meet(most), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hexadecimal digits, and the least doc_id that a chain of links reaches.

    Fingerprints link where they differ in `most` bits or fewer; all such links
    count, found without a pair of equal fingerprints being made.  Defined
    results: a null text counts as empty; texts without a word have the
    fingerprint 0, linked like any other; very long texts are taken whole;
    rows that share a doc_id stay rows of their own; rows without a doc_id get
    fingerprints and component, but are no component's least id (null if none
    has one); ties do not arise; other columns are ignored; no rows give none.
    """
    prints = written(fingerprints(docs, id_col, text_col))
    codes = written(prints.groupBy("code", "rank").agg(F.min("doc_id").alias("least")))
    found = components(links(codes.select("code", "rank"), most))
    grouped = written(codes.join(found, codes.code == found.node, "left").select("code", "least", F.coalesce("comp", "code").alias("comp")))
    least = grouped.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = written(spread_join(grouped.select("code", "comp"), least, "comp").select("code", "component_id"))
    return spread_join(prints.select("doc_id", "code"), named, "code").select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
