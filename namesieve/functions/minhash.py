"""MinHash signatures: a declarative form, and the fast form over Arrow batches."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import EL_CLUSTER, EL_MATCH, EMPTY, HASH_MOD, SHINGLE, hash_family
from .text import clean_name, hash20, shingles

_ROWS = 16_384


def signature(clean: Column, m: int = EL_CLUSTER) -> Column:
    """Least permuted shingle hash for each permutation, as ARRAY<BIGINT>: the specification form.

    The hashes are bound to a variable (an array of one), else every permutation would hash all shingles anew.
    """
    a, b = hash_family(m)
    family = F.array(*(F.struct(F.lit(int(x)).alias("a"), F.lit(int(y)).alias("b")) for x, y in zip(a, b, strict=True)))
    hashes = F.transform(shingles(clean), hash20)
    return F.transform(F.array(hashes), lambda h: F.transform(family, lambda p: F.array_min(F.transform(h, lambda x: (p["a"] * x + p["b"]) % HASH_MOD))))[0]


def _hash(text: str) -> int:
    return int(hashlib.sha256(text.encode()).hexdigest()[-5:], 16)


@cache
def _trigram_table() -> np.ndarray:
    """Permuted hashes of every trigram over a blank and a-z: 27^3 rows of 200."""
    letters = " abcdefghijklmnopqrstuvwxyz"
    h = np.array([_hash(x + y + z) for x in letters for y in letters for z in letters], np.int64)
    a, b = hash_family()
    return ((h[:, None] * a + b) % HASH_MOD).astype(np.int32)


def signatures_of(column: pa.Array) -> np.ndarray:
    """(n, 200) signatures of cleaned names, all in NumPy; the shingle of a name below three letters is hashed on its own."""
    table = _trigram_table()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    code = np.where(raw == 32, 0, raw.astype(np.int64) - 96)
    size = np.diff(offsets)
    each = np.maximum(size - (SHINGLE - 1), 0)
    out = np.empty((len(size), EL_CLUSTER), np.int64)
    a, b = hash_family()
    for i in np.flatnonzero(each == 0):
        text = raw[offsets[i] : offsets[i + 1]].tobytes().decode() or EMPTY
        out[i] = (_hash(text) * a + b) % HASH_MOD
    long = np.flatnonzero(each)
    ends = np.cumsum(each[long])
    at = 0
    while at < len(long):  # a bounded number of shingles at a time
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + _ROWS, "right")))
        rows = long[at:to]
        n = each[rows]
        start = np.repeat(offsets[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        grams = code[start] * 729 + code[start + 1] * 27 + code[start + 2]
        out[rows] = np.minimum.reduceat(table[grams], np.cumsum(n) - n)
        at = to
    return out


def batch_encode(names: DataFrame, name: str = "name", nfkc: bool = True) -> DataFrame:
    """All columns of names, and clean, sig (ARRAY<BIGINT> of 200), n2_200, n2_50 (squared norms); rows with a null name go.

    A narrow stage: cleaning in the JVM, signatures in Arrow batches.
    """
    base = names.where(F.col(name).isNotNull()).withColumn("clean", clean_name(F.col(name), nfkc))
    kept = base.columns

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                sig = signatures_of(part.column("clean"))
                square = sig * sig
                cols = {c: part.column(c) for c in kept}
                cols["sig"] = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * EL_CLUSTER), pa.array(sig.ravel()))
                cols["n2_200"], cols["n2_50"] = pa.array(square.sum(1)), pa.array(square[:, :EL_MATCH].sum(1))
                yield pa.RecordBatch.from_pydict(cols)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return base.mapInArrow(run, f"{kinds}, sig array<bigint>, n2_200 bigint, n2_50 bigint")


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column whose lists have `width` numbers, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column):
        raise ValueError(f"every vector must have {width} elements")
    return flat.reshape(-1, width).astype(np.float64)
