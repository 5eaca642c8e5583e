"""Best-fit packing.

`pieces` cuts encoded documents into pieces of at most `size` ids; `assign`
gives every piece a sequence and an offset by bulk-synchronous best fit.

Pieces of more than half a sequence open one each.  The others come in ranges of
length, the long ones first (halves of the range before).  A round sorts the
range's pieces and the open gaps together by size, descending, into range
partitions.  A successor sweep over each partition gives a piece the least gap
before it that is still free; a wide gap stands there as several slots, each
with room for any piece of the range.  Pieces and slots that a partition leaves
over are matched across partitions by rank: only their numbers for each
partition go to the driver, a prefix sum says which ranks of which partition a
piece takes, and a join on (partition, rank) fetches the slot.  So no slot is
ever claimed twice.  Gaps shrink by what they took, and the round repeats with
the pieces that are left; where few found a gap, new sequences open first, as
many as the pieces' ids need.  No piece is ever dropped; the driver holds counts
of partitions, never pieces, gaps or lengths.

Null texts count as empty ones (the end id alone); rows that share a doc_id, or
repeat, are packed as documents of their own; pieces of equal length are told
apart by their place in the written table; texts of any length are cut; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import careful, free, frugal, written
from .tokens import encoder

#: Share of pieces that must find a gap, else new sequences open; rows of a range partition; least width of a range of lengths.
FEW, SWEEP_ROWS, NARROW = 0.1, 250_000, 256
_SWEPT = "kind int, part int, rank long, pid long, length long, seq long, slot long, gap long"


def pieces(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids on demand.

    Only documents of more than `size` ids are cut; the first piece takes what
    the whole pieces after it leave.
    """
    careful(docs.sparkSession)

    def cut(batches):
        tokens = encoder(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0)
            for a, ids, rows in tokens.documents(batch.column(1), end_id):
                n = np.diff(rows)
                count = np.maximum(-(-n // size), 1)
                owner = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                first = n - (count - 1) * size
                start = np.where(piece > 0, first[owner] + (piece - 1) * size, 0)
                length = np.where(piece > 0, size, first[owner])
                at = rows[:-1][owner] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                out = {
                    "doc_id": doc_ids.take(pa.array(owner + a)),
                    "piece": pa.array(piece.astype(np.int32)),
                    "start": pa.array(start),
                    "length": pa.array(length),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * s : 4 * (s + m)]) for s, m in zip(at.tolist(), length.tolist(), strict=True)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(frugal(cut, keep_encoder=True), schema)


def _match(batches):
    """One partition's successor sweep over (size, kind, id, slot, gap), descending: 0 matches, 1 pieces and 2 slots left over, ranked."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    slots, pairs, rest = [], [], []
    for batch in batches:
        for size, kind, i, slot, gap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                slots.append((i, slot, gap))
            elif slots:
                pairs.append((i, size, *slots.pop()))
            else:
                rest.append((i, size))
    for kind, rows, names in ((0, pairs, ("pid", "length", "seq", "slot", "gap")), (1, rest, ("pid", "length")), (2, slots, ("seq", "slot", "gap"))):
        if rows:
            n = len(rows)
            cols = dict(zip(names, zip(*rows, strict=True), strict=True))
            out = {"kind": pa.array(np.full(n, kind, np.int32)), "part": pa.array(np.full(n, part, np.int32)), "rank": pa.array(np.arange(n))}
            yield pa.RecordBatch.from_pydict(out | {c: pa.array(cols[c], pa.int64()) if c in cols else pa.nulls(n, pa.int64()) for c in ("pid", "length", "seq", "slot", "gap")})


def across(ends: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (partition, pieces left, slots left), in order: (partition, first and end rank of pieces, partition of the slots, rank of the first piece's slot); ranks of slots descend."""
    steps, stack = [], []
    for part, pieces_left, slots_left in ends:
        done = 0
        while done < pieces_left and stack:
            owner, n = stack.pop()
            take = min(pieces_left - done, n)
            steps.append((part, done, done + take, owner, n - 1))
            done += take
            if take < n:
                stack.append((owner, n - take))
        if slots_left:
            stack.append((part, slots_left))
    return steps


def _sweep(todo: DataFrame, gaps: DataFrame, least: int, top: int, rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed pieces, pieces left, gaps left) of one round; all read from written tables."""
    spark = todo.sparkSession
    wide = gaps.where(F.col("gap") >= least).withColumn("k", F.greatest(F.floor(F.col("gap") / top), F.lit(1).cast("long")))
    slots = wide.select(F.floor(F.col("gap") / F.col("k")).alias("size"), F.lit(0).alias("kind"), F.col("seq").alias("id"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("slot"), "gap")
    events = slots.union(todo.select("length", F.lit(1), "pid", F.lit(0).cast("long"), F.lit(0).cast("long")))
    order = [F.desc("size"), "kind", "id", "slot"]
    ranged = events.repartitionByRange(rows // SWEEP_ROWS + 1, *order).sortWithinPartitions(*order)
    table = written(ranged.mapInArrow(frugal(_match), _SWEPT))

    ends: dict[int, list[int]] = {}
    for r in table.where("kind > 0").groupBy("part", "kind").agg(F.count("*").alias("n")).collect():  # two rows for each partition
        ends.setdefault(r.part, [0, 0])[r.kind - 1] = r.n
    steps = across([(p, *n) for p, n in sorted(ends.items())])
    steps = spark.createDataFrame(pa.table({c: pa.array([r[k] for r in steps], kind) for k, (c, kind) in enumerate({"p": pa.int32(), "low": pa.int64(), "high": pa.int64(), "owner": pa.int32(), "top": pa.int64()}.items())}))
    pieces_left = table.where("kind = 1").select("part", "rank", "pid", "length")
    asked = pieces_left.join(F.broadcast(steps), (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")), "left")
    wanted = asked.where("owner is not null").select("pid", "length", F.col("owner").alias("part"), (F.col("top") - F.col("rank") + F.col("low")).alias("rank"))
    late = wanted.join(table.where("kind = 2").select("part", "rank", "seq", "slot", "gap"), ["part", "rank"])
    pairs = table.where("kind = 0").select("pid", "length", "seq", "slot", "gap").union(late.select("pid", "length", "seq", "slot", "gap"))

    before = F.coalesce(F.sum("length").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = written(pairs.select("pid", "seq", "length", "gap", before.alias("before")))
    used = placed.groupBy("seq").agg(F.sum("length").alias("used"))
    now = written(gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap")).where("gap > 0"))
    return placed, asked.where("owner is null").select("pid", "length"), now


def assign(parts: DataFrame, size: int = 1024) -> DataFrame:
    """The pieces, whose column `length` counts, with sequence_id and offset."""
    pid = free("pid", parts.columns)
    parts = written(parts.withColumn(pid, F.monotonically_increasing_id()))
    spark = parts.sparkSession
    seen = parts.agg(F.min("length").alias("least"), F.max("length").alias("most")).first()
    if seen.least is not None and not 0 < seen.least <= seen.most <= size:
        raise ValueError(f"pieces must have 1 to {size} ids")
    every = parts.select(F.col(pid).alias("pid"), F.col("length").cast("long").alias("length"))
    alone = every.where(F.col("length") > size // 2)
    found = alone.select("pid", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    gaps = alone.where(F.col("length") < size).select(F.col("pid").alias("seq"), (F.lit(size) - F.col("length")).cast("long").alias("gap"))
    high, opened = size // 2, 0
    while high:
        low = high // 2 if high >= 2 * NARROW else 0
        todo, before, found_gap = every.where((F.col("length") > low) & (F.col("length") <= high)), 0, True
        while True:
            left = todo.agg(F.count("*").alias("n"), F.sum("length").alias("total"), F.min("length").alias("least"), F.max("length").alias("top")).first()
            if not left.n:
                break
            if before:
                found_gap = before - left.n >= FEW * before
            room = gaps.where(F.col("gap") >= left.least).agg(F.count("*").alias("n"), F.sum(F.greatest(F.floor(F.col("gap") / left.top), F.lit(1))).alias("slots")).first()
            slots = room.slots or 0
            if not found_gap or not slots:
                new = -(-left.total // size)
                gaps = gaps.union(spark.range(opened + 1, opened + new + 1).select((-F.col("id")).alias("seq"), F.lit(size).cast("long").alias("gap")))
                opened += new
                slots += new * (size // left.top)
            placed, todo, gaps = _sweep(todo, gaps, left.least, left.top, left.n + slots)
            found = found.union(placed.select("pid", F.col("seq").alias("sequence_id"), (F.lit(size) - F.col("gap") + F.col("before")).alias("offset")))
            before = left.n
        high = low
    return parts.join(found.withColumnRenamed("pid", pid), pid).drop(pid)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2, with_ids: bool = False, **columns: str) -> DataFrame:
    """Encode, cut and pack whole documents."""
    return assign(pieces(docs, tokenizer, size, end_id, with_ids=with_ids, **columns), size)
