"""Quoted CSV files read by many tasks, line feeds in quotes included.

Files are cut by bytes into lines, by Spark's text reader.  A first pass counts,
for each block of a file, the quotes and the lines that would end a record if
the block began outside or inside quotes; with a prefix sum over blocks (all
that comes to the driver: a row a block) each block knows whether it begins in
quotes, and the number of its first record.  A second pass joins the lines of
each record; only records that cross the border of two blocks are shuffled.

Quotes must stand as RFC 4180 says: around a field, and doubled inside one.
Blank lines outside quotes are no records; a byte-order mark is dropped.  An
unclosed quote makes the rest of its file one record.
"""

from __future__ import annotations

import csv

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

RECORD = "_record"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _stretches(batch: pa.RecordBatch):
    """(file, block, first line, end) of the lines of one block."""
    files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    at = 0
    while at < batch.num_rows:
        to = at + 1
        while to < batch.num_rows and blocks[to] == blocks[at] and files[to] == files[at]:
            to += 1
        yield files[at], blocks[at], at, to
        at = to


def _measured(batch: pa.RecordBatch, at: int, to: int):
    """Lines, quotes before the end of each, and whether each is blank."""
    text = batch.column(0).slice(at, to - at)
    quotes = pc.cumulative_sum(pc.count_substring(text, '"')).to_numpy(zero_copy_only=False)
    return text, quotes, pc.is_in(text, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)


def _count(batches):
    """A row for each block: its quotes, and the lines that end a record if it begins outside (even) or inside (odd) of quotes."""
    def row(where, quotes, ends):
        return pa.RecordBatch.from_pydict({"file": pa.array([where[0]]), "block": pa.array([where[1]]), "quotes": pa.array([quotes]), "even": pa.array([ends[0]]), "odd": pa.array([ends[1]])})

    where, so_far, ends = None, 0, [0, 0]
    for batch in batches:
        for file, block, at, to in _stretches(batch):
            if (file, block) != where:
                if where:
                    yield row(where, so_far, ends)
                where, so_far, ends = (file, block), 0, [0, 0]
            _, quotes, blank = _measured(batch, at, to)
            for p in (0, 1):
                ends[p] += int((((quotes + so_far + p) % 2 == 0) & ~blank).sum())
            so_far += int(quotes[-1])
    if where:
        yield row(where, so_far, ends)


def _starts(counts: list) -> dict[tuple[str, int], tuple[int, int, int]]:
    """(quotes before it modulo 2, number of its first record, number of its file's first record) of each block."""
    out, record, parity, file, first = {}, 0, 0, None, 0
    for r in sorted(counts, key=lambda r: (r.file, r.block)):
        if r.file != file:
            record += parity  # an unclosed record of the file before
            file, parity, first = r.file, 0, record
        out[r.file, r.block] = (parity, record, first)
        record += r.odd if parity else r.even
        parity = (parity + r.quotes) % 2
    return out


def _joined(starts: dict):
    """Records and pieces of records: record, block (of a piece; -1 for a whole record), text, header."""
    def run(batches):
        where, state = None, None

        def rest():
            if state and state["open"]:
                yield (state["record"], where[1], "\n".join(state["open"]), state["record"] == state["first"])

        def table(rows):
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["record", "block", "text", "header"])

        for batch in batches:
            rows = []
            for file, block, at, to in _stretches(batch):
                if (file, block) != where:
                    rows += rest()
                    where, (parity, record, first) = (file, block), starts[file, block]
                    state = {"parity": parity, "record": record, "first": first, "open": [], "torn": bool(parity)}
                text, quotes, blank = _measured(batch, at, to)
                ends = (quotes + state["parity"]) % 2 == 0
                for line, end, empty in zip(text.to_pylist(), ends.tolist(), blank.tolist(), strict=True):
                    if end and empty and not state["open"] and not state["torn"]:
                        continue
                    state["open"].append(line)
                    if end:
                        rows.append((state["record"], block if state["torn"] else -1, "\n".join(state["open"]), state["record"] == state["first"]))
                        state |= {"record": state["record"] + 1, "open": [], "torn": False}
                state["parity"] = int(quotes[-1] + state["parity"]) % 2
            yield table(rows)
        yield table(list(rest()))

    return run


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """The records of a CSV with a header, all columns text, and _record, ascending in file order (with gaps at headers).

    Blocks are of spark.sql.files.maxPartitionBytes; files of a folder have the same header.
    """
    lines = _lines(spark, str(path))
    starts = _starts(lines.mapInArrow(_count, "file string, block long, quotes long, even long, odd long").collect())  # a row a block
    found = lines.mapInArrow(_joined(starts), "record long, block long, text string, header boolean")
    pieces = found.where("block >= 0").groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n").alias("text"), F.bool_or("header").alias("header"))
    records = found.where("block < 0").select("record", "text", "header").unionByName(pieces)
    first = records.where("header").orderBy("record").first()
    names = next(csv.reader([first.text.removeprefix("\ufeff").rstrip("\r")])) if first else []
    if not names:
        return spark.createDataFrame([], StructType([StructField(RECORD, LongType())]))
    quoted = [f"`{n.replace('`', '``')}` string" for n in names]
    parsed = F.from_csv(F.regexp_replace("text", "\r$", ""), ", ".join(quoted), {"quote": '"', "escape": '"'})
    rows = records.where("not header").select(F.col("record").alias(RECORD), parsed.alias("_row"))
    return rows.select("_row.*", RECORD)


def positions(rows: DataFrame, id_col: str, order: str = RECORD, cell: int = 1 << 16) -> DataFrame:
    """rows with their zero-based positions in the order of a number that tells them apart: ranks in cells of numbers, and prefix sums over the cells."""
    dealt = rows.withColumn("_cell", F.floor(F.col(order) / cell))
    sizes = dealt.groupBy("_cell").agg(F.count("*").alias("_n"))
    base = sizes.select("_cell", (F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_cell").orderBy(order)) - 1
    return dealt.withColumn("_within", within).join(base, "_cell").withColumn(id_col, F.col("_base") + F.col("_within")).drop("_cell", "_within", "_base")
