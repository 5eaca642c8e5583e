"""Document fingerprints by locally consistent parsing.

A text is a string of code points.  On each level, runs of a symbol become one
symbol; deterministic coin tossing (index and value of the lowest bit that
differs from the left neighbour, three times) leaves labels below 8 that differ
from their neighbours; a phrase starts at each local maximum; and its name is a
hash of its symbols.  Where a phrase starts depends on a few symbols around it,
so equal substrings have the same phrases except near their ends, at any
offset.  Names of the third level (some 25 code points each) identify a text;
the fingerprint holds the `keep` least of them, which estimates the resemblance
of the sets of names of two texts without bias.

Null and empty texts have the empty fingerprint, which is like itself alone; very
long texts are parsed whole; equal names count once, so there are no ties;
repeated rows have equal fingerprints, and are each other's next document (rows
that share a doc_id go by text); extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_volume, careful, frugal, written
from ._text import mix

LEVELS, KEEP = 3, 64
_POW = np.multiply.accumulate(np.full(256, 0x2545F4914F6CDD1D, np.uint64))
_LEAST = -(1 << 63)


def _names(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A name for each block of symbols between starts."""
    length = np.diff(np.append(starts, len(symbols)))
    place = np.arange(len(symbols)) - np.repeat(starts, length)
    return mix(np.add.reduceat(symbols * _POW[place & 255], starts) + length.astype(np.uint64))


def _level(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases and which of them start a text; first: which symbols start a text."""
    fresh = first.copy()
    fresh[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(fresh)
    if len(starts) < len(x):
        run = np.diff(np.append(starts, len(x))).astype(np.uint64)
        x, first = np.where(run > 1, mix(x[starts] + run * np.uint64(0x9E3779B97F4A7C15)), x[starts]), first[starts]
    label = x
    for _ in range(3):
        before = np.empty_like(label)
        before[0], before[1:] = 0, label[:-1]
        before = np.where(first, label ^ np.uint64(1), before)
        low = label ^ before
        low &= np.uint64(0) - low
        label = (np.bitwise_count(low - np.uint64(1)).astype(np.uint64) << np.uint64(1)) | (label & low != 0)
    peak = first.copy()
    after = np.append(label[1:], np.uint64(0))
    after[:-1][first[1:]] = 0  # what follows in the batch is another text
    peak[1:] |= (label[1:] > label[:-1]) & (label[1:] >= after[1:])
    peak[1:] &= ~first[:-1] | first[1:]
    starts = np.flatnonzero(peak)
    return _names(x, starts), first[starts]


def phrase_names(texts: list[str], levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Names on the last level of all texts, and text offsets."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    full = np.flatnonzero(sizes)
    rows = np.zeros(len(texts) + 1, np.int64)
    if not len(full):
        return np.zeros(0, np.uint64), rows
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    first = np.zeros(len(points), bool)
    first[(np.cumsum(sizes) - sizes)[full]] = True
    x = mix(points + np.uint64(1))
    for _ in range(levels):
        x, first = _level(x, first)
    each = np.diff(np.append(np.flatnonzero(first), len(x)))
    rows[full + 1] = each
    return x, np.cumsum(rows)


def sketches(texts: list[str], levels: int = LEVELS, keep: int = KEEP) -> list[np.ndarray]:
    """The least `keep` 32-bit names of each text, ascending."""
    names, rows = phrase_names(texts, levels)
    short = (names >> np.uint64(32)).astype(np.uint32)
    return [np.unique(short[a:b])[:keep] for a, b in zip(rows[:-1], rows[1:], strict=True)]


def likeness(a: np.ndarray, b: np.ndarray, keep: int = KEEP) -> float:
    """Estimated resemblance of the sets that two sketches come from."""
    both = np.union1d(a, b)[:keep]
    if not len(both):
        return 1.0
    return float(np.isin(both, a, assume_unique=True) @ np.isin(both, b, assume_unique=True).astype(np.int64)) / len(both)


def _digest(ids: list, texts: list[str], following: list[str]) -> dict[str, pa.Array]:
    """The result rows of consecutive documents, each with the text of the one after it."""
    edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, following, strict=True)]
    both = sketches([*texts, *edited, *following[-1:]])
    own, changed = both[: len(texts)], both[len(texts) : 2 * len(texts)]
    after = [*own[1:], both[-1]]
    raw = lambda s: s.astype(">u4").tobytes()
    return {
        "doc_id": pa.array(ids, pa.int64()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in edited], pa.binary()),
        "fingerprint": pa.array([raw(s) for s in own], pa.binary()),
        "edited_fingerprint": pa.array([raw(s) for s in changed], pa.binary()),
        "near_edited": pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)]),
        "near_next": pa.array([likeness(a, b) for a, b in zip(own, after, strict=True)]),
    }


_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", levels: int = LEVELS, keep: int = KEEP) -> DataFrame:
    """doc_id and the sketch of each text as an array; no shuffle."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                found = sketches([t or "" for t in part.column(1).to_pylist()], levels, keep)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "names": pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(frugal(run), "doc_id long, names array<long>")


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to it and to the next document.

    Documents are dealt by range of doc_id (rows that share one: by text; null
    first), so each finds the next one beside it; only the last of a partition
    waits for the first of the next non-empty one, and those few rows meet in a
    join on the partition's number.
    """
    spark = docs.sparkSession
    careful(spark)
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ranged = base.repartitionByRange(by_volume(docs, text_col), "k").sortWithinPartitions("k", "t")
    extra = ", kind int, part int, t string"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ends = lambda ids, texts, kind: pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), **{c: pa.nulls(1, t) for c, t in (("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()))}, "kind": pa.array([kind], pa.int32()), "part": pa.array([part], pa.int32()), "t": pa.array(texts)})
        held: tuple[list, list] = ([], [])
        begun = False
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a in range(0, batch.num_rows, 512):
                i, t = held[0] + ids.slice(a, 512).to_pylist(), held[1] + texts.slice(a, 512).to_pylist()
                if not begun:
                    begun = True
                    yield ends(i[:1], t[:1], 1)
                if len(i) > 1:
                    out = _digest(i[:-1], t[:-1], t[1:])
                    n = len(i) - 1
                    yield pa.RecordBatch.from_pydict(out | {"kind": pa.array([0] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "t": pa.nulls(n, pa.string())})
                held = (i[-1:], t[-1:])
        if begun:
            yield ends(*held, 2)

    table = written(ranged.mapInArrow(frugal(run), _RESULT + extra))
    ends = table.where("kind > 0").select("kind", "part", "doc_id", "t")
    parts = sorted(r.part for r in ends.where("kind = 1").select("part").collect())  # a number for each partition
    shown = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    if not parts:
        return spark.createDataFrame([], _RESULT).withColumns(shown)
    follow = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]], strict=True)), "part int, after int")
    last = ends.where("kind = 2").select("part", "doc_id", "t").join(follow, "part")
    last = last.join(ends.where("kind = 1").select(F.col("part").alias("after"), F.col("t").alias("n")), "after").select("doc_id", "t", "n")

    def close(batches):
        for batch in batches:
            for i, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_pydict(_digest([i], [t], [n]))

    out = table.where("kind = 0").select(*_RESULT.replace(",", "").split()[::2]).union(last.mapInArrow(frugal(close), _RESULT))
    return out.withColumns(shown | {"doc_id": F.nullif("doc_id", F.lit(_LEAST))})
