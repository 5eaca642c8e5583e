"""Corpus counts of hashed items: a count table partitioned by hash, fed and read in sorted blocks.

Documents are dealt into chunks and hashes into buckets.  A chunk sends each
bucket its distinct hashes (56 bits, ascending, as gaps of five bytes or so)
with its own counts; the bucket sums them over all chunks and sends each chunk
back a bit for each of its hashes, and the sum where other chunks hold it too.

Chunks and buckets have a fixed size while a cell (one chunk, one bucket) holds
`CELL` hashes or more on average; beyond that both grow as the square root of
the corpus, so the number of cells stays linear in it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import slots

CHUNK_CHARS, BUCKET_ITEMS, CELL = 8 << 20, 4_000_000, 200
CELLS = "bucket int, chunk int, width int, h binary, n binary, large binary"
SHARED = "chunk int, bucket int, size long, back binary, total binary, large binary"
#: Partitions of a shuffle at most (or spark.sql.shuffle.partitions, if that is more), so that its blocks stay countable; a task then takes several groups, one by one.
PARTITIONS = 10_000
_DOWN = np.uint64(8)


def grid(chars: int, items: int, chunk_chars: int = CHUNK_CHARS, bucket_items: int = BUCKET_ITEMS) -> tuple[int, int]:
    """Numbers of chunks and buckets for a corpus of so many characters and about so many hashes."""
    chunks, buckets = -(-chars // chunk_chars) or 1, -(-items // bucket_items) or 1
    over = chunks * buckets * CELL / max(items, 1)
    if over > 1 and chunks > 1000:
        chunks, buckets = (max(1, round(x / over**0.5)) for x in (chunks, buckets))
    return chunks, buckets


def apart(df: DataFrame, column: str, n: int) -> DataFrame:
    """df dealt by a column of n values; where these are more than spark.sql.shuffle.partitions, over as many partitions, so that what a task reads does not grow with the corpus."""
    least = slots(df.sparkSession)
    return df.repartition(min(n, max(PARTITIONS, least)), column) if n > least else df


def short(h: np.ndarray) -> np.ndarray:
    """The upper 56 bits, which counts go by."""
    return h >> _DOWN


def _packed(h: np.ndarray) -> tuple[int, bytes]:
    gaps = np.diff(h, prepend=np.uint64(0))
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return width, np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(width: int, data: bytes) -> np.ndarray:
    raw = np.zeros((len(data) // width, 8), np.uint8)
    raw[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64)


def _small(n: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as single bytes, and those that do not fit apart."""
    return np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype("<i8").tobytes()


def _whole(small: bytes, large: bytes) -> np.ndarray:
    n = np.frombuffer(small, np.uint8).astype(np.int64)
    n[n == 255] = np.frombuffer(large, "<i8")
    return n


def cells(h: np.ndarray, n: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """What a chunk sends: h ascending and distinct, with its counts."""
    bucket = ((h >> np.uint64(24)) * np.uint64(buckets)) >> np.uint64(32)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, np.int64)
    some, cut = bucket[first].astype(np.int32), np.append(first, len(h))
    coded = [_small(n[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    # gaps count from where the bucket begins
    base = (some.astype(np.uint64) << np.uint64(32)) // np.uint64(buckets) << np.uint64(24)
    packed = [_packed(h[a:b] - base[k]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
    return pa.table({
        "bucket": pa.array(some),
        "chunk": pa.array(np.full(len(some), chunk, np.int32)),
        "width": pa.array([w for w, _ in packed], pa.int32()),
        "h": pa.array([x for _, x in packed], pa.binary()),
        "n": pa.array([x for x, _ in coded], pa.binary()),
        "large": pa.array([x for _, x in coded], pa.binary()),
    })


def add(table: pa.Table) -> pa.Table:
    """Sums of one bucket, and what each chunk lacks of them."""
    parts = [_unpacked(w, x) for w, x in zip(table["width"].to_pylist(), table["h"].to_pylist(), strict=True)]
    h = np.concatenate(parts)
    n = np.concatenate([_whole(x, y) for x, y in zip(table["n"].to_pylist(), table["large"].to_pylist(), strict=True)])
    ends = np.cumsum([len(x) for x in parts])
    cut = [slice(e - len(x), e) for e, x in zip(ends, parts, strict=True)]
    del parts
    by = np.argsort(h, kind="stable")
    h = h[by]
    at = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    many = np.diff(np.append(at, len(h)))
    del h
    total = np.empty(len(n), np.int64)
    total[by] = np.repeat(np.add.reduceat(n[by], at), many)
    back = total != n
    coded = [_small(total[c][back[c]]) for c in cut]
    return pa.table({
        "chunk": table["chunk"].cast(pa.int32()),
        "bucket": table["bucket"].cast(pa.int32()),
        "size": pa.array([c.stop - c.start for c in cut], pa.int64()),
        "back": pa.array([np.packbits(back[c]).tobytes() for c in cut], pa.binary()),
        "total": pa.array([x for x, _ in coded], pa.binary()),
        "large": pa.array([x for _, x in coded], pa.binary()),
    })


def totals(shared: pa.Table, n: np.ndarray) -> np.ndarray:
    """Corpus counts of a chunk's hashes, from what it got back and its own counts."""
    shared = shared.sort_by("bucket")
    sizes = shared["size"].to_pylist()
    if sum(sizes) != len(n):
        raise RuntimeError("the documents of a chunk changed between two reads of them")
    out = n.astype(np.int64)
    if sizes:
        back = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(shared["back"].to_pylist(), sizes, strict=True)]).astype(bool)
        out[back] = np.concatenate([_whole(x, y) for x, y in zip(shared["total"].to_pylist(), shared["large"].to_pylist(), strict=True)])
    return out
