"""MinHash near-dedup by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles, weight = (1 + ln
occurrences) x (ln(documents / documents with the shingle) + 1).  Document
counts are those of the whole table, for every shingle (`_counts`); what a
document keeps of them is a code of 16 bits a shingle (exact below 32,768,
then in steps of a thousandth of their logarithm).

Improved consistent weighted sampling draws for each hash function and shingle
r, c ~ Gamma(2, 1) and b ~ U(0, 1), here from tables addressed by a hash of the
shingle, and takes the shingle of least ln c - r (floor(ln w / r + b) - b + 1),
with ln w rounded to steps of 0.05.  `bands` x `rows` samples are banded: at 0.8
a pair shares a band with probability 0.9998.

In a large group of copies the shingles that its members share are frequent just
because of the group, and an edit, which no other document has, outweighs them
the more the larger the corpus is.  So a pair is similar too if its plain sets of
shingles are: as many bands come from plain MinHash samples.

Candidates are verified by exact Jaccard similarity on the whole texts, the
larger one of the weighted and the plain.  Texts with equal words are one class from the start.  A bucket links
its members to its least one, which keeps candidates linear; members that are
then still in other classes meet a second leader; what then remains of buckets
that hold several classes is compared block by block: those outside a bucket's
largest class with all, products of matrices bounding the similarities of all
pairs of two blocks from above; only pairs across classes that may reach the
threshold leave it and are verified.  A large bucket is spread over many blocks,
no pair across classes is missed, and none within one is compared again.

A row per document comes back: doc_id, class_id (the least doc_id of the class),
n_links (verified links to other texts on the way to the class).  Null texts and
texts without words are classes of their own; shorter texts than five words are
one shingle; long texts are taken whole; rows that share a doc_id are documents
of their own, as are those without (their class_id is null if no member has a
doc_id); of equal texts the least doc_id is first; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _counts
from ._spark import careful, components, frugal, identified, tidy, written
from ._text import Words, mix, slices, stream

SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 16, 4
STARS, BLOCK, COLUMNS = 2, 256, 4096
_BITS, _STEP, _EXACT = 16, 0.05, 1 << 15


class Sets:
    """Sorted distinct shingles of a batch's rows with their occurrences; key: 128 bits of each row's words."""

    def __init__(self, column: pa.Array, shingle: int = SHINGLE):
        w = Words(column)
        every, rows = w.shingles(shingle)
        every = every.copy()
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            every[a:b].sort()
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        new[rows[:-1][np.diff(rows) > 0]] = True
        at = np.flatnonzero(new)
        self.hash, self.times = every[at], np.diff(np.append(at, len(every)))
        self.rows = np.searchsorted(at, rows)
        self.word, self.word_rows = w.hash, w.rows  # bytes and places of words are not held

    def keys(self) -> np.ndarray:
        """Two 64-bit hashes of each row's sequence of words."""
        out = np.zeros((len(self.word_rows) - 1, 2), np.int64)
        full = np.flatnonzero(np.diff(self.word_rows))
        if len(full):
            place = np.arange(len(self.word)) - np.repeat(self.word_rows[:-1], np.diff(self.word_rows))
            for k in (0, 1):
                # a seed for each place keeps the order of words, and the mixing makes the sum one of independent values
                term = mix(self.word + mix(place.astype(np.uint64) + np.uint64((k + 1) << 40)))
                out[full, k] = np.add.reduceat(term, self.word_rows[:-1][full]).view(np.int64)
        return out


def code(df: np.ndarray) -> np.ndarray:
    """Document counts in 16 bits: themselves below 32,768, beyond that the logarithm in steps of a thousandth."""
    return np.where(df < _EXACT, df, _EXACT + np.round(1000 * np.log(np.maximum(df, 1)))).astype("<u2")


@cache
def _log_counts() -> np.ndarray:
    """Natural logarithm of the count behind each code."""
    n = np.arange(1 << 16)
    return np.where(n < _EXACT, np.log(np.maximum(n, 1)), (n - _EXACT) / 1000)


def weights(times: np.ndarray, codes: np.ndarray, n_docs: int) -> np.ndarray:
    """Weights of shingles by their occurrences in the document and the codes of their document counts."""
    return (1 + np.log(times)) * (np.maximum(np.log(n_docs) - _log_counts()[codes], 0) + 1)


class Sampler:
    """Consistent weighted samples of weighted sets; values of each rounded weight are tabulated when first met."""

    def __init__(self, size: int):
        unit = lambda seed: (stream(seed, 1 << _BITS).astype(np.float64) + 1) / 2.0**64
        self.r = -np.log(unit(21) * unit(22))
        self.c = np.log(-np.log(unit(23) * unit(24)))
        self.b = unit(25)
        self.factor, self.salt = stream(26, size) | np.uint64(1), stream(27, size) | np.uint64(1)
        self.table, self.known = np.empty((0, 1 << _BITS), np.uint32), np.zeros(0, bool)

    def _values(self, step: int) -> np.ndarray:
        """Sampling values of one weight at all table entries, as unsigned integers of the same order."""
        value = (self.c - self.r * (np.floor(_STEP * step / self.r + self.b) - self.b + 1)).astype(np.float32)
        bits = value.view(np.uint32)
        return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))

    def sample(self, hashes: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(size, sets): each sample names a shingle and its quantised weight."""
        step = np.round(np.log(weight) / _STEP).astype(np.int64)
        most = int(step.max(initial=0)) + 1
        if most > len(self.known):
            self.table = np.concatenate((self.table, np.empty((most - len(self.known), 1 << _BITS), np.uint32)))
            self.known = np.append(self.known, np.zeros(most - len(self.known), bool))
        for k in np.unique(step):
            if not self.known[k]:
                self.table[k], self.known[k] = self._values(int(k)), True
        flat, base = self.table.ravel(), step << _BITS
        out = np.empty((len(self.factor), len(starts)), np.uint64)
        down, half = np.uint64(64 - _BITS), np.uint64(32)
        for k in range(len(self.factor)):
            at = ((hashes * self.factor[k]) >> down).view(np.int64)
            at += base
            key = flat[at].astype(np.uint64)
            key <<= half
            key |= (hashes * self.salt[k]) >> half
            out[k] = np.minimum.reduceat(key, starts)
        return out


def plain_samples(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """(size, sets): MinHash samples of the sets, whatever their weights."""
    out = np.empty((size, len(starts)), np.uint64)
    for k, factor in enumerate(stream(28, size) | np.uint64(1)):
        np.minimum.reduceat(hashes * factor, starts, out=out[k])
    return out


@cache
def sampler(size: int) -> Sampler:
    """The sampler of this process, whose tables do not depend on the data."""
    return Sampler(size)


def _marks(base: DataFrame, n_docs: int, chars: int, shingle: int, bands: int, rows: int, chunk_chars: int, bucket_items: int) -> DataFrame:
    """key, k1, k2, bands, codes of each document; bands: those of weighted samples, then those of plain ones, none for a document without words."""
    chunks, buckets = _counts.grid(chars, chars // 6, chunk_chars, bucket_items)
    dealt = base.select("key", F.coalesce("text", F.lit("")).alias("text")).withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))

    def parts(table: pa.Table) -> list[Sets]:
        text = table["text"].combine_chunks()
        return [Sets(text.slice(a, b - a), shingle) for a, b in slices(text)]

    def distinct(held: list[Sets]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(_counts.short(np.concatenate([s.hash for s in held])), return_counts=True)

    def count(table: pa.Table) -> pa.Table:
        tidy()
        return _counts.cells(*distinct(parts(table)), table["chunk"][0].as_py(), buckets)

    def mark(table: pa.Table, shared: pa.Table) -> pa.Table:
        out = {c: [] for c in ("k1", "k2", "bands", "codes")}
        if table.num_rows:
            tidy()
            held = parts(table)
            h, own = distinct(held)
            codes = code(_counts.totals(shared, own))
            draw, mixer = sampler(bands * rows), stream(31, rows) | np.uint64(1)
            for sets in held:
                mine = codes[np.searchsorted(h, _counts.short(sets.hash))]
                keys, full = sets.keys(), np.flatnonzero(np.diff(sets.rows))
                band = np.zeros((len(sets.rows) - 1, 2 * bands), np.int64)
                if len(full):
                    starts = sets.rows[:-1][full]
                    got = np.concatenate((draw.sample(sets.hash, weights(sets.times, mine, n_docs), starts), plain_samples(sets.hash, starts, bands * rows)))
                    band[full] = mix((mix(got.reshape(2 * bands, rows, -1)) * mixer[:, None]).sum(1)).view(np.int64).T
                size = np.zeros(len(band), np.int64)
                size[full] = 2 * bands
                out["k1"].append(pa.array(keys[:, 0]))
                out["k2"].append(pa.array(keys[:, 1]))
                out["bands"].append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(band[full].ravel())))
                raw = mine.tobytes()
                out["codes"].append(pa.array([raw[2 * a : 2 * b] for a, b in zip(sets.rows[:-1].tolist(), sets.rows[1:].tolist(), strict=True)], pa.binary()))
        kinds = {"k1": pa.int64(), "k2": pa.int64(), "bands": pa.list_(pa.int64()), "codes": pa.binary()}
        return pa.table({"key": table["key"].cast(pa.int64())} | {c: pa.chunked_array(x, kinds[c]) for c, x in out.items()})

    dealt = _counts.apart(dealt, "chunk", chunks)
    counted = dealt.groupBy("chunk").applyInArrow(count, _counts.CELLS)
    shared = _counts.apart(counted, "bucket", buckets).groupBy("bucket").applyInArrow(_counts.add, _counts.SHARED)
    return dealt.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(mark, "key long, k1 long, k2 long, bands array<long>, codes binary")


def _weighted(text: pa.Array, codes: pa.Array, n_docs: int, shingle: int) -> tuple[Sets, np.ndarray]:
    sets = Sets(text, shingle)
    return sets, weights(sets.times, np.frombuffer(b"".join(codes.to_pylist()), "<u2"), n_docs)


def similarities(a: tuple[pa.Array, pa.Array], b: tuple[pa.Array, pa.Array], n_docs: int, shingle: int = SHINGLE) -> np.ndarray:
    """Jaccard similarity of each text of a with that of b, weighted or plain, whichever is larger; each side: texts and codes."""
    (x, wx), (y, wy) = _weighted(*a, n_docs, shingle), _weighted(*b, n_docs, shingle)
    out = np.zeros(len(a[0]))
    for i in range(len(out)):
        p, q = slice(*x.rows[i : i + 2]), slice(*y.rows[i : i + 2])
        at = np.searchsorted(y.hash[q], x.hash[p])
        at = np.minimum(at, max(q.stop - q.start - 1, 0))
        if q.stop > q.start and p.stop > p.start:
            common = y.hash[q][at] == x.hash[p]
            least = np.minimum(wx[p], wy[q][at])[common].sum()
            both = np.count_nonzero(common)
            out[i] = max(least / (wx[p].sum() + wy[q].sum() - least), both / (len(at) + q.stop - q.start - both))
    return out


def _verified(pairs: DataFrame, texts: DataFrame, n_docs: int, threshold: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of similar texts."""
    def run(batches):
        for batch in batches:
            for i, j in slices(batch.column(2), 4 << 20):
                part = batch.slice(i, j - i)
                good = similarities((part.column(2), part.column(3)), (part.column(4), part.column(5)), n_docs, shingle) >= threshold
                yield part.select([0, 1]).filter(pa.array(good))

    one = texts.select(F.col("key").alias("a"), F.col("text").alias("x"), F.col("codes").alias("p"))
    two = texts.select(F.col("key").alias("b"), F.col("text").alias("y"), F.col("codes").alias("q"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "p", "y", "q").mapInArrow(frugal(run), "a long, b long")


def _close_pairs(left: DataFrame, texts: DataFrame, n_docs: int, threshold: float, shingle: int) -> DataFrame:
    """Pairs (a, b) of one bucket and two classes whose similarity may reach the threshold; left: bucket, key, comp."""
    def packed(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 2 << 20):
                sets, w = _weighted(batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a), n_docs, shingle)
                ids, w = (sets.hash >> np.uint64(32)).astype("<u4"), w.astype("<f4")
                cut = list(zip(sets.rows[:-1].tolist(), sets.rows[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_pydict({"key": batch.column(0).slice(a, b - a), "ids": pa.array([ids[x:y].tobytes() for x, y in cut], pa.binary()), "w": pa.array([w[x:y].tobytes() for x, y in cut], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block, docs, comp = (table[c].to_numpy() for c in ("block", "key", "comp"))
        one, two = np.flatnonzero(block == i), np.flatnonzero(block == j)
        ids = [np.frombuffer(x, "<u4") for x in table["ids"].to_pylist()]
        every, where, times = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
        w = np.concatenate([np.frombuffer(x, "<f4") for x in table["w"].to_pylist()])
        row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
        total, size = np.bincount(row, w, len(ids)), np.array([len(x) for x in ids])
        column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[where]
        common, both = np.zeros((2, len(one), len(two)))
        for c in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            some = (column >= c) & (column < c + COLUMNS)
            m = np.zeros((len(ids), COLUMNS), np.float32)
            np.add.at(m, (row[some], column[some] - c), np.sqrt(w[some]))
            common += m[one] @ m[two].T
            m = (m > 0).astype(np.float32)
            both += m[one] @ m[two].T
        most = np.maximum(common / np.maximum(total[one][:, None] + total[two] - common, 1e-9), both / np.maximum(size[one][:, None] + size[two] - both, 1e-9))
        x, y = np.nonzero((most >= threshold - 1e-3) & (comp[one][:, None] != comp[two]))
        a, b = docs[one[x]], docs[two[y]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    sets = texts.select("key", "text", "codes").mapInArrow(frugal(packed), "key long, ids binary, w binary")
    sizes = left.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    blocks = sizes.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    blocks = written(blocks.select("bucket", "main", F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("int").alias("rest"), F.ceil(F.col("most") / BLOCK).cast("int").alias("mains")))
    dealt = left.select("bucket", "key", "comp").join(blocks, "bucket").withColumn("ours", F.col("comp") == F.col("main"))
    # blocks 0 to rest - 1 hold the members outside the largest class, those after them the ones in it, which need not meet
    block = F.when(F.col("ours"), F.col("rest") + F.pmod(F.xxhash64("key"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("key"), F.col("rest")))
    dealt = dealt.withColumn("block", block.cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("ours"), F.col("rest")).otherwise(F.col("rest") + F.col("mains")) - 1)))
    dealt = dealt.select("bucket", "key", "comp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    near = dealt.join(sets, "key").groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")
    return near.distinct()


def _classes(base: DataFrame, threshold: float, shingle: int, bands: int, rows: int, chunk_chars: int, bucket_items: int) -> DataFrame:
    """key, comp (a key that the rows of a class share), n_links; base: key, doc_id, text."""
    size = base.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    n_docs = max(size.n, 1)
    marks = written(_marks(base, n_docs, size.chars or 0, shingle, bands, rows, chunk_chars, bucket_items))
    keyed = marks.where("size(bands) > 0").select("key", "k1", "k2", "bands")
    copied = written(keyed.groupBy("k1", "k2").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).where("copies > 1").select("k1", "k2", "rep"))
    firsts = keyed.join(copied, ["k1", "k2"], "left").where("rep is null or rep = key")
    banded = firsts.select("key", F.posexplode("bands").alias("band", "value")).select("key", F.xxhash64("band", "value").alias("bucket"))
    shared = written(banded.groupBy("bucket").agg(F.min("key").alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", "lead"))
    members = written(banded.join(shared, "bucket"))
    wanted = marks.select("key", "codes").join(members.select("key").distinct(), "key")
    texts = written(base.select("key", "text").join(wanted, "key"))

    links = done = comp = None
    left = members.withColumn("comp", F.col("key")).withColumn("lead_comp", F.col("lead"))
    for _ in range(STARS):
        pairs = written(left.where("comp <> lead_comp").select(F.least("lead", "key").alias("a"), F.greatest("lead", "key").alias("b")).distinct())
        new = pairs if done is None else pairs.join(done, ["a", "b"], "left_anti")
        found = written(_verified(new, texts, n_docs, threshold, shingle))
        done = pairs if done is None else done.union(pairs)
        links = found if links is None else links.union(found)
        comp = written(components(links))
        # a leader has met all others; the next one is the least of those that are left
        rest = left.where("key <> lead").select("bucket", "key")
        placed = written(rest.join(comp, rest.key == comp.node, "left").select("bucket", "key", F.coalesce("comp", "key").alias("comp")))
        leads = placed.groupBy("bucket").agg(F.min("key").alias("lead"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min_by("comp", "key").alias("lead_comp"))
        leads = written(leads.where("c1 < c2").select("bucket", "lead", "lead_comp"))
        left = written(placed.join(leads, "bucket"))
        if left.isEmpty():
            break
    else:
        pairs = _close_pairs(left, texts, n_docs, threshold, shingle).join(done, ["a", "b"], "left_anti")
        links = links.union(written(_verified(written(pairs), texts, n_docs, threshold, shingle)))
        comp = written(components(links))

    links = links.distinct()
    counts = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
    node = F.when(F.size("bands") > 0, F.coalesce("rep", "key")).otherwise(F.col("key")).alias("node")
    out = marks.join(copied, ["k1", "k2"], "left").select("key", node).join(comp, "node", "left").join(counts, "node", "left")
    return out.select("key", F.coalesce("comp", "node").alias("comp"), F.coalesce("n", F.lit(0)).alias("n_links"))


def _firsts(docs: DataFrame, id_col: str, text_col: str, threshold: float, shingle: int, bands: int, rows: int, chunk_chars: int, bucket_items: int) -> tuple[DataFrame, str, DataFrame]:
    """docs with a row key, its name, and (key, doc_id, first, class_id, n_links): the key and doc_id of the first row of each row's class."""
    careful(docs.sparkSession)
    tagged, key = identified(docs, id_col)
    base = tagged.select(F.col(key).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(_classes(base, threshold, shingle, bands, rows, chunk_chars, bucket_items))
    ids = found.join(base.select("key", "doc_id"), "key")
    first = written(ids.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")))
    return tagged, key, ids.join(first, "comp").select("key", "doc_id", F.col("first.key").alias("first"), F.col("first.doc_id").alias("class_id"), "n_links")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = _counts.CHUNK_CHARS, bucket_items: int = _counts.BUCKET_ITEMS) -> DataFrame:
    """doc_id, class_id, n_links of every row (links between different texts; copies are not expanded)."""
    return _firsts(docs, id_col, text_col, threshold, shingle, bands, rows, chunk_chars, bucket_items)[2].select("doc_id", "class_id", "n_links")


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each class: the one of the least doc_id, those without one last."""
    tagged, key, found = _firsts(docs, id_col, text_col, threshold, shingle, bands, rows, _counts.CHUNK_CHARS, _counts.BUCKET_ITEMS)
    gone = found.where("key <> first").select(F.col("key").alias(key))
    return tagged.join(gone, key, "left_anti").select(docs.columns)
