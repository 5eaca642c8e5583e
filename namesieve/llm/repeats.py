"""Substring dedup: hashed units, the earliest kept.

Units are whole lines and, within them, sentences and the stretches between
capitalised words, so a passage that was pasted into the middle of a line falls
into units of its own.  A unit's digest is 96 bits of hashes of its words
(lower case, without punctuation).  For each digest the unit with the least
(document, number) is the first; every other one, of the same document too,
repeats it.  A line that repeats a line goes whole, with its signs and its end,
however short it is; of the units within lines, runs of neighbouring repeats of at
least `least_words` words go.  The first units stay, and offsets in code points refer to the original text.

Digests are grouped with a partial minimum, so a digest that a third of all
units share costs each task one row; only digests of two units or more are
joined back.  Texts are cut in one pass each, however long.  Null texts are
empty, documents without words keep their text, extra columns are ignored, an
empty table gives no rows.  Rows that share a doc_id, or have none, are documents
of their own (in the order of a hash of their texts, those without a doc_id last,
rows that repeat in any order); only where there are such rows the table is
sorted and written with a rank.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import careful, frugal, tidy, written
from ._text import Words, code_points, mix, slices, stream

LEAST_WORDS = 10
_FACTORS = [stream(seed, 1 << 12) | np.uint64(1) for seed in (11, 13)]
_LINE = stream(12, 1)[0]  # lines repeat lines alone


def _units(column: pa.Array) -> dict[str, np.ndarray]:
    """Units of the rows, stretches and then whole lines: row, number, start and end in code points, words, digest, line, later."""
    w = Words(column)
    n = len(w.hash)
    if not n:
        return {}
    raw = w.raw
    points = code_points(raw)
    row = np.searchsorted(w.offsets, w.start, "right") - 1
    begins = np.zeros(n, bool)
    begins[w.rows[:-1][np.diff(w.rows) > 0]] = True
    head = raw[w.start]
    after = raw[np.minimum(w.start + 1, len(raw) - 1)]
    capital = (head >= 65) & (head <= 90) | (head == 0xC3) & (after >= 0x80) & (after <= 0x9E)
    breaks = np.flatnonzero(raw == 10)
    lines = begins.copy()
    lines[1:] |= np.diff(np.searchsorted(breaks, w.start)) > 0
    stops = np.concatenate(([0], np.cumsum((raw == 46) | (raw == 33) | (raw == 63) | (raw == 10))))
    begins[1:] |= capital[1:] | (stops[w.start[1:]] > stops[w.end[:-1]])
    parts = [_units_from(w, row, points, np.flatnonzero(begins | lines)), _units_from(w, row, points, np.flatnonzero(lines))]
    whole = parts[1]
    # a whole line reaches from the end of the line before to its own end
    at = np.searchsorted(breaks, w.start[np.flatnonzero(lines)])
    ends = np.append(breaks + 1, len(raw))
    low = np.maximum(np.append(0, ends)[at], w.offsets[:-1][whole["row"]])
    high = np.minimum(ends[at], w.offsets[1:][whole["row"]])
    base = points[w.offsets[:-1]][whole["row"]]
    whole |= {"start": points[low] - base, "end": points[high] - base, "digest": mix(whole["digest"].view(np.uint64) ^ _LINE).view(np.int64)}
    out = {c: np.concatenate([p[c] for p in parts]) for c in whole}
    out["check"] = out["check"].astype(np.int32)
    return out | {"line": np.repeat([False, True], [len(p["row"]) for p in parts]), "later": _later(out["row"], out["digest"])}


def _units_from(w: Words, row: np.ndarray, points: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """Units that begin at these words."""
    n = len(w.hash)
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    place = np.arange(n) - np.repeat(first, size)
    turn = (place >> 12).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16)  # even, so that factors stay odd
    digest, check = (mix(np.add.reduceat(w.hash * (factor[place & 4095] + turn), first) + size.astype(np.uint64)) for factor in _FACTORS)
    new_row = np.append(True, row[first][1:] != row[first][:-1])
    number = np.arange(len(first)) - np.repeat(np.flatnonzero(new_row), np.diff(np.append(np.flatnonzero(new_row), len(first))))
    base = points[w.offsets[:-1]][row[first]]
    return {"row": row[first], "unit": number, "start": points[w.start[first]] - base, "end": points[w.end[last]] - base, "words": size, "digest": digest.view(np.int64), "check": (check >> np.uint64(33)).view(np.int64)}


def _later(row: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Which units repeat an earlier one of their row."""
    order = np.lexsort((digest, row))  # stable, so the first of equals comes first
    out = np.zeros(len(row), bool)
    out[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
    return out


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, unit, start, end, words, digest, check, line, later (repeats a unit of its row) of all units; no shuffle."""
    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                found = _units(batch.column(1).slice(a, b - a))
                if found:
                    out = {"doc_id": batch.column(0).take(pa.array(found["row"] + a)), "digest": pa.array(found["digest"]), "check": pa.array(found["check"]), "line": pa.array(found["line"]), "later": pa.array(found["later"])}
                    yield pa.RecordBatch.from_pydict(out | {c: pa.array(found[c].astype(np.int32)) for c in ("unit", "start", "end", "words")})

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(frugal(run), "doc_id long, digest long, check int, line boolean, later boolean, unit int, start int, end int, words int")


def _ranked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, rank of each row; ranks are distinct and in the order of doc_id."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if base.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return base.withColumn("rank", F.col("doc_id"))
    return written(base.orderBy(F.col("doc_id").asc_nulls_last(), F.xxhash64("text")).withColumn("rank", F.monotonically_increasing_id()))


def _spans(ranked: DataFrame, least_words: int) -> DataFrame:
    """rank, start, end, keeper of the spans that go, apart from each other; keeper: the rank of the row that keeps a span's first unit."""
    table = written(units(ranked, "rank").withColumnRenamed("doc_id", "rank"))
    seen = table.groupBy("digest", "check").agg(F.min("rank").alias("keeper"), F.max("rank").alias("other"), F.max("later").alias("within")).where("keeper < other or within").select("digest", "check", "keeper")
    seen = written(seen)  # apart from the exchange below it, so that a hot digest's partition of the join can be split
    again = table.join(seen, ["digest", "check"]).where("rank > keeper or later")
    by = Window.partitionBy("rank")
    # all of a document's rows stay together, so runs, spans and their union need one exchange; stretches come before lines
    run = again.withColumn("run", F.when(F.col("line"), F.col("unit")).otherwise(F.col("unit") - F.row_number().over(by.orderBy("line", "unit"))))
    spans = run.groupBy("rank", "line", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min_by("keeper", "unit").alias("keeper"))
    spans = spans.where(F.col("line") | (F.col("words") >= least_words))
    order = by.orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.withColumn("new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    parted = parted.withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return parted.groupBy("rank", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("keeper", "start").alias("keeper")).drop("span")


def repeated_spans(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end, keeper of the spans that go; keeper: the document that keeps a span's first unit."""
    careful(docs.sparkSession)
    ranked = _ranked(docs, id_col, text_col)
    names = ranked.select("rank", "doc_id")
    keepers = names.select(F.col("rank").alias("keeper"), F.col("doc_id").alias("kept_by"))
    return _spans(ranked, least_words).join(names, "rank").join(keepers, "keeper").select("doc_id", "start", "end", F.col("kept_by").alias("keeper"))


def _cut(texts: pd.Series, removed: pd.Series) -> pd.DataFrame:
    """Texts without the spans, and the number of words in each span; null where nothing goes."""
    tidy()
    kept, words = [], []
    for text, spans in zip(texts, removed, strict=True):
        if text is None or spans is None:
            kept.append(None)
            words.append(None)
            continue
        at, parts, counts = 0, [], []
        for span in spans:
            parts.append(text[at : span["start"]])
            counts.append(len(text[span["start"] : span["end"]].split()))
            at = span["end"]
        kept.append("".join([*parts, text[at:]]))
        words.append(counts)
    return pd.DataFrame({"text": pd.Series(kept, dtype=object), "words": pd.Series(words, dtype=object)})


def remove_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without its repeats, the removed spans (start, end) in the original text, and the words in each."""
    careful(docs.sparkSession)
    ranked = _ranked(docs, id_col, text_col)
    spans = _spans(ranked, least_words).groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))
    base = ranked.select("rank", "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(spans, "rank", "left")
    cut = F.pandas_udf(_cut, "text string, words array<int>")(F.when(F.col("removed").isNotNull(), F.col("text")), F.col("removed"))
    base = base.select("doc_id", "text", "removed", cut.alias("cut"))
    return base.select("doc_id", F.coalesce("cut.text", "text").alias("text"), F.coalesce("removed", F.array().cast("array<struct<start:int,end:int>>")).alias("removed"), F.coalesce("cut.words", F.array().cast("array<int>")).alias("words"))
