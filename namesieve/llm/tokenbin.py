"""Token-ID / binary output.

`write_token_files` encodes documents in ascending doc_id order into flat files
of unsigned integers, one shard for each range partition, and 64-bit document
offsets beside them.  Shards are written independently; a prefix sum over
their lengths gives each one its base, so offsets are positions in the whole
corpus.  `read_token_files` maps the files into memory and returns one row per
document.

Layout of a folder: `ids-<part>-<attempt>.bin` (little-endian unsigned, 16 bits
where the vocabulary allows it, else 32), `ids-<part>-<attempt>.idx` (int64: n,
then n doc_ids, then n + 1 offsets within the shard).  A shard is written under
a temporary name and renamed when whole, and only the attempt that Spark
accepted is listed, so lost executors and speculative tasks do no harm.

There are as many shards as spark.sql.shuffle.partitions, or more, so that none
holds much over 64 million characters.  Null texts are empty (the end id alone),
very long ones are encoded whole, null doc_ids come first (as the least 64-bit
integer), rows that share a doc_id are ordered by text, ties beyond that are
equal rows, extra columns are ignored, an empty table gives no shards.
"""

from __future__ import annotations

import os
import uuid
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import by_volume, careful, frugal, shared_folder
from .tokens import encoder

LEAST = -(1 << 63)


def _local(folder: str) -> str:
    """Path of a folder that executors reach as files: file: URIs, plain paths and mounted shares."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"token files are memory-mapped; {folder} is not a mounted folder")
    return url.path


def write_token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> list[dict]:
    """Write the files; the manifest: path, number of documents and ids, base of each shard, in order.

    One shuffle, by range of doc_id.  What comes to the driver is a row for each shard.
    """
    spark = docs.sparkSession
    careful(spark)
    at = _local(folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")

    def shard(batches):
        from pyspark import TaskContext

        ctx = TaskContext.get()
        os.makedirs(at, exist_ok=True)
        name = f"{at}/ids-{ctx.partitionId():06d}-{ctx.taskAttemptId()}"
        tokens = encoder(tokenizer)
        kind = np.uint16 if len(tokens.width) <= 1 << 16 else np.uint32
        ids_of, sizes, total = [], [], 0
        with open(f"{name}.tmp", "wb") as f:
            for batch in batches:
                ids_of.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                for _, ids, rows in tokens.documents(batch.column(1), end_id):
                    f.write(ids.astype(kind).tobytes())
                    sizes.append(np.diff(rows))
                    total += len(ids)
        doc_ids = np.concatenate([np.zeros(0, np.int64), *ids_of])
        if not len(doc_ids):
            os.remove(f"{name}.tmp")
            return
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]), dtype=np.int64)
        with open(f"{name}.idx.tmp", "wb") as f:
            f.write(np.concatenate(([len(doc_ids)], doc_ids, ends)).astype("<i8").tobytes())
        os.rename(f"{name}.idx.tmp", f"{name}.idx")
        os.rename(f"{name}.tmp", f"{name}.bin")
        yield pa.RecordBatch.from_pydict({"part": [ctx.partitionId()], "path": [name], "n_docs": [len(doc_ids)], "n_ids": [total], "bits": [8 * kind().itemsize]})

    ordered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST)).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ordered = ordered.repartitionByRange(shards or by_volume(docs, text_col), "k").sortWithinPartitions("k", "t")
    rows = ordered.mapInArrow(frugal(shard, keep_encoder=True), "part long, path string, n_docs long, n_ids long, bits long").collect()
    manifest, base = [], 0
    for r in sorted(rows):
        manifest.append(r.asDict() | {"base": base})
        base += r.n_ids
    return manifest


def open_shard(path: str, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, offsets within the shard, ids), mapped into memory."""
    index = np.memmap(f"{path}.idx", "<i8", "r")
    n = int(index[0])
    ids = np.memmap(f"{path}.bin", f"<u{bits // 8}", "r") if os.path.getsize(f"{path}.bin") else np.zeros(0, f"<u{bits // 8}")
    return index[1 : n + 1], index[n + 1 :], ids


def read_token_files(spark: SparkSession, manifest: list[dict], with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, and the ids themselves on demand."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not manifest:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([(m["path"], m["bits"], m["base"]) for m in manifest], "path string, bits long, base long")

    def read(batches):
        for batch in batches:
            for path, bits, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc_ids, ends, ids = open_shard(path, bits)
                for a in range(0, len(doc_ids), 4096):
                    b = min(a + 4096, len(doc_ids))
                    at = ends[a : b + 1]
                    part = np.asarray(ids[at[0] : at[-1]]).astype("<u4")
                    cut = at - at[0]
                    out = {
                        "doc_id": pa.array(np.asarray(doc_ids[a:b])).to_pylist() if LEAST in doc_ids[a:b] else pa.array(np.asarray(doc_ids[a:b])),
                        "start": pa.array(np.asarray(at[:-1]) + base),
                        "n_tokens": pa.array(np.diff(at)),
                        "ids_crc32": pa.array([zlib.crc32(part[x:y].tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.int64()),
                    }
                    if isinstance(out["doc_id"], list):
                        out["doc_id"] = pa.array([None if x == LEAST else x for x in out["doc_id"]], pa.int64())
                    if with_ids:
                        out["ids"] = pa.LargeListArray.from_arrays(pa.array(cut), pa.array(part.astype(np.int64))).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return shards.repartition(min(len(manifest), 4096)).mapInArrow(frugal(read), schema)
