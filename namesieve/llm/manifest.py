"""A Merkle manifest of a data set: every row can prove that it belongs to one root.

Rows hash to leaves; the leaves of a group, in order of id, are leaves of a
tree of fan-out 16, and the groups' roots in turn.  Places in the order are
prefix sums over range-sorted partitions, so that they hold for any group
size.  A group is cut into buckets of 16^3 leaves that begin at multiples of
16^3, hence are whole subtrees: executors hash each in DuckDB, level by level,
by ordered string_agg and sha256.  Spark combines the roots of buckets and of
groups, a level a round, and joins to each bucket the siblings above it (its
outer proof); a second pass over the buckets proves the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import careful, frugal, slots, written

FAN = 16
LEVELS = 3
BUCKET = FAN**LEVELS
#: Leaves that one DuckDB query takes; a bucket is never split.
AT_ONCE = 2 * BUCKET
#: Rows of one range-sorted partition, from which on there are more partitions than spark.sql.shuffle.partitions.
PART_ROWS = 1_000_000

_ITEMS = "items array<struct<pos:long,doc_id:long,leaf:string,changed:string>>"
_SIZE = f"CASE WHEN n = 1 THEN 0 {' '.join(f'WHEN n <= {FAN**k} THEN {k}' for k in range(1, LEVELS))} ELSE {LEVELS} END"
_NODES = "SELECT r, unnest(items).pos AS pos, unnest(items).leaf AS digest FROM b"


def leaf(fields: list[Column]) -> Column:
    """sha256 in hexadecimal digits over all fields: '-' for null, else the number of bytes, ':' and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """rows (a written table) with pos, the place in the order within the group from 0, and n, the size of the group.

    Range-sorted partitions are counted and numbered by themselves; a prefix
    sum over the counts gives each its start.  Rows that the order leaves tied
    are split among partitions all the same.
    """
    parts = min(max(slots(rows.sparkSession), rows.count() // PART_ROWS), 10_000)
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, group, *order, "_tie")
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()))
    tally = ranged.groupBy(group, "_part").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tally.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("n", F.sum("_size").over(Window.partitionBy(group))).drop("_size")
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order, "_tie"))
    return ranged.withColumn("_row", place).join(starts, [group, "_part"]).withColumn("pos", F.col("_start") + F.col("_row") - 1).drop("_tie", "_part", "_row", "_start")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Buckets in tables of at most about AT_ONCE leaves, numbered in column r."""
    for b in batches:
        sizes = b.column("items").value_lengths().to_pylist()
        at = 0
        while at < len(sizes):
            to, held = at + 1, sizes[at]
            while to < len(sizes) and held + sizes[to] <= AT_ONCE:
                held, to = held + sizes[to], to + 1
            part = pa.Table.from_batches([b.slice(at, to - at)])
            yield part.append_column("r", pa.array(range(to - at), pa.int64()))
            at = to


def _connect() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})


def _runs(con: duckdb.DuckDBPyConnection, chunk: pa.Table) -> None:
    """Tables run0, run1, run2: the digests of each run of siblings, joined, of the levels that a bucket has."""
    con.register("b", chunk)
    con.sql(f"CREATE OR REPLACE TEMP TABLE size AS SELECT r, {_SIZE} AS levels FROM b")
    below = f"({_NODES})"
    for k in range(LEVELS):
        con.sql(f"CREATE OR REPLACE TEMP TABLE run{k} AS SELECT r, pos // {FAN} AS pos, string_agg(digest, '' ORDER BY pos) AS t FROM {below} JOIN size USING (r) WHERE levels > {k} GROUP BY ALL")
        below = f"(SELECT r, pos, sha256(t) AS digest FROM run{k})"


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _connect()
    for chunk in _chunks(batches):
        _runs(con, chunk)
        found = " UNION ALL ".join(f"SELECT r, sha256(t) AS digest FROM run{k} JOIN size USING (r) WHERE levels = {k + 1}" for k in range(LEVELS))
        yield from con.sql(f"SELECT key, bucket, digest FROM b JOIN (SELECT r, digest FROM ({_NODES}) JOIN size USING (r) WHERE levels = 0 UNION ALL {found}) USING (r)").to_arrow_table().to_batches()


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    con = _connect()
    for chunk in _chunks(batches):
        _runs(con, chunk)
        pieces, fold = [], "coalesce(changed, leaf)"
        for k in range(LEVELS):
            at = f"64 * ((x.pos // {FAN**k}) % {FAN})"
            before, behind = f"substr(run{k}.t, 1, {at})", f"substr(run{k}.t, {at} + 65)"
            pieces.append(f"coalesce({before} || {behind}, '')")
            fold = f"CASE WHEN run{k}.t IS NULL THEN {fold} ELSE sha256({before} || {fold} || {behind}) END"
        deepest = con.sql("SELECT coalesce(max(len(befores)), 0) FROM b").fetchall()[0][0]
        joins = " ".join(f"LEFT JOIN run{k} ON run{k}.r = x.r AND run{k}.pos = x.pos // {FAN ** (k + 1)}" for k in range(LEVELS))
        query = f"SELECT x.r, doc_id, leaf, {' || '.join(pieces)} AS inner_proof, {fold} AS fold FROM (SELECT r, unnest(items, recursive := true) FROM b) x {joins}"
        for k in range(1, deepest + 1):  # above the bucket
            query = f"SELECT q.* REPLACE (CASE WHEN len(befores) >= {k} THEN sha256(befores[{k}] || fold || behinds[{k}]) ELSE fold END AS fold) FROM ({query}) q JOIN b USING (r)"
        above = "array_to_string(list_transform(befores, lambda x, i: x || behinds[i]), '')"
        result = con.sql(f"SELECT doc_id, leaf, subroot, root, inner_proof || coalesce({above}, '') AS proof, fold AS folded_root FROM ({query}) q JOIN b USING (r)")
        yield from result.to_arrow_table().to_batches(max_chunksize=1024)


def climb(nodes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The trees above nodes (key, idx, digest, n), one a key; n is how many nodes the key has.

    Returns (key, idx, befores, behinds), the joined digests of the siblings on
    both sides at each level from below, and (key, digest), the root of each.
    A round halves no more than a group of 16 at once, so no group is large.
    """
    nodes = written(nodes)
    most = nodes.agg(F.max("n")).first()[0] or 0
    empty = F.array().cast("array<string>")
    paths = nodes.select(key, "idx", F.col("idx").alias("_at"), "n", empty.alias("befores"), empty.alias("behinds"))
    tops, level = nodes.where("n = 1").select(key, "digest"), nodes.where("n > 1")
    while most > 1:
        run = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "digest"))), lambda x: x["digest"]), "")
        runs = written(level.groupBy(key, F.floor(F.col("idx") / FAN).alias("idx"), F.ceil(F.col("n") / FAN).alias("n")).agg(run.alias("t")))
        here = runs.select(key, F.col("idx").alias("_run"), "t")
        joined = paths.withColumn("_run", F.floor(F.col("_at") / FAN)).join(here, [key, "_run"], "left")
        cut = (64 * F.pmod("_at", F.lit(FAN))).cast("int")
        grown = {c: F.when(F.col("t").isNull(), F.col(c)).otherwise(F.concat(F.col(c), F.array(t))) for c, t in (("befores", F.substring("t", F.lit(1), cut)), ("behinds", F.substring("t", cut + 65, F.length("t"))))}
        paths = written(joined.withColumns(grown | {"_at": F.col("_run")}).select(key, "idx", "_at", "n", "befores", "behinds"))
        above = runs.select(key, "idx", F.sha2("t", 256).alias("digest"), "n")
        tops, level = tops.union(above.where("n = 1").select(key, "digest")), above.where("n > 1")
        most = -(-most // FAN)
    return paths.select(key, "idx", "befores", "behinds"), tops


@dataclass(frozen=True)
class Manifest:
    """Written tables: leaves in buckets; (key, idx, befores, behinds) above buckets; (key, subroot, befores, behinds) of groups; the root, one row."""

    buckets: DataFrame
    paths: DataFrame
    groups: DataFrame
    root: DataFrame


def build(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None, where: Column | None = None) -> Manifest:
    """The manifest of docs; a row's leaf is the hash of its fields.

    Groups are the values of group_col (null first, then by bytes), in each the
    rows ascend by id_col (null first, ties by leaf).  changed holds what a
    tampered copy has in place of some fields, for rows `where` is true of.
    """
    spark = docs.sparkSession
    careful(spark)
    source = F.col(group_col).cast("string")
    other = F.when(F.coalesce(where, F.lit(False)), leaf([(changed or {}).get(f, F.col(f)) for f in fields])) if where is not None else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("-"))  # '-' sorts before '='
    rows = written(docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), leaf([F.col(f) for f in fields]).alias("leaf"), other.alias("changed")))
    placed = numbered(rows, "key", [F.asc_nulls_first("doc_id"), F.asc("leaf")])
    bucket = F.floor(F.col("pos") / BUCKET)
    buckets = written(placed.groupBy("key", bucket.alias("bucket"), "n").agg(F.collect_list(F.struct("pos", "doc_id", "leaf", "changed")).alias("items")))
    roots = buckets.select("key", "bucket", "n", "items").mapInArrow(frugal(_roots), "key string, bucket long, digest string")
    sizes = buckets.select("key", F.col("bucket"), F.ceil(F.col("n") / BUCKET).alias("n"))
    paths, subroots = climb(roots.join(sizes, ["key", "bucket"]).withColumnRenamed("bucket", "idx"), "key")
    ranked = numbered(written(subroots.withColumn("_all", F.lit(0))), "_all", [F.asc("key")])
    ranked = written(ranked.withColumnRenamed("pos", "idx"))
    above, root = climb(ranked.select("_all", "idx", "digest", "n"), "_all")
    groups = ranked.select("key", "idx", F.col("digest").alias("subroot")).join(above.drop("_all"), "idx").drop("idx")
    return Manifest(buckets, paths, written(groups), written(root.select(F.col("digest").alias("root"))))


def prove(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified) for every row.

    proof is the siblings on the way to the root, joined from below, left to
    right; folded_root is what they and the changed leaf (where there is none,
    the leaf itself) give, and verified whether that is the root.  Defined
    results: null fields count as such; rows that share an id or have none get
    places of their own; equal rows too; a group of one row has its leaf as
    subroot; one row in all has an empty proof; no rows give none; very long
    texts are hashed whole; columns that are not named are ignored.
    """
    groups = manifest.groups.select("key", "subroot", F.col("befores").alias("_b"), F.col("behinds").alias("_h"))
    outer = manifest.paths.withColumnRenamed("idx", "bucket").join(groups, "key").select("key", "bucket", "subroot", F.concat("befores", "_b").alias("befores"), F.concat("behinds", "_h").alias("behinds"))
    whole = manifest.buckets.join(outer, ["key", "bucket"]).crossJoin(F.broadcast(manifest.root))  # one row
    proven = whole.select("n", "items", "subroot", "root", "befores", "behinds").mapInArrow(frugal(_proofs), "doc_id long, leaf string, subroot string, root string, proof string, folded_root string")
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
