"""The clustered index of a name list.

A saved index is a folder of versions.  A version is a set of Parquet tables;
the members are packed in blocks of a cluster and bucketed by block, so that
screening joins them where they lie.  Its manifest names every file with its
size, and is written last, under its final name by one rename: readers see a
whole version or none, and refuse one whose files are not those of the manifest.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.minhash import batch_encode, matrix
from ..params import EL_MATCH, choose_k
from ..sources.tables import small_batches, written
from . import kmeans, scaler, threshold

BUCKETS, MANIFEST = 64, "MANIFEST.json"


@dataclass
class Index:
    """centroids (k, 200), scaler vectors, members (cluster_id, column_index, id, name, sig50, n2_50), and the sizes; blocks: members packed and bucketed, of a loaded index."""

    centroids: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    members: DataFrame
    n: int
    max_size: int
    blocks: DataFrame | None = None

    @property
    def k(self) -> int:
        return len(self.centroids)

    def release(self) -> None:
        """Nothing is cached: members are a written table, which survives the loss of executors."""


def column_index(assigned: DataFrame, id_col: str = "id", cell: int = 1 << 16) -> DataFrame:
    """Rank of each row inside its cluster, in the order of ids.

    Ids are cut into cells; rows are ranked within (cluster, cell), and a prefix
    sum over a cluster's cells gives each its base, so no task holds more of a
    giant cluster than a cell.
    """
    dealt = assigned.withColumn("_cell", F.floor(F.col(id_col) / cell))
    sizes = dealt.groupBy("cluster_id", "_cell").agg(F.count("*").alias("_n"))
    order = Window.partitionBy("cluster_id").orderBy("_cell")
    base = sizes.select("cluster_id", "_cell", (F.sum("_n").over(order) - F.col("_n")).alias("_base"))
    within = F.row_number().over(Window.partitionBy("cluster_id", "_cell").orderBy(id_col)) - 1
    ranked = dealt.withColumn("_within", within).join(base, ["cluster_id", "_cell"])
    return ranked.select(*assigned.columns, (F.col("_base") + F.col("_within")).alias("column_index"))


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """(cluster_id, n) with empty clusters."""
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    return every.join(assigned.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id", "left").fillna(0, ["n"])


def size_summary(sizes: DataFrame) -> DataFrame:
    """(least, most, mean) of cluster sizes."""
    return sizes.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def build_index(names: DataFrame, k: int | str = "sqrt", seed: int = 42, id_col: str = "id", name: str = "name") -> Index:
    """Offline preparation: encode, standardise, cluster, lay out; ids may be any numbers, and are positions for parity."""
    small_batches(names.sparkSession)
    base = names.select(F.col(id_col).cast("bigint").alias("id"), F.col(name).alias("name"))
    encoded = written(batch_encode(base))
    n = encoded.count()
    if not n:
        raise ValueError("the name list is empty")
    mean, scale = scaler.collected(scaler.fit_scaler(encoded))
    points = written(scaler.standardised(encoded, mean, scale))
    centroids = kmeans.fit(points, choose_k(n, k), seed)
    placed = kmeans.assign(points, centroids).select("cluster_id", "id", "name", F.slice("sig", 1, EL_MATCH).alias("sig50"), "n2_50")
    members = written(column_index(placed))
    most = members.agg(F.max("column_index")).first()[0] + 1
    return Index(centroids, mean, scale, members, n, most)


def packed(members: DataFrame, size: int = threshold.BLOCK) -> DataFrame:
    """(block, ids, vectors): members of a cluster in blocks of `size` columns, ids being column numbers; block is cluster_id x 2^32 and the number of the block."""
    block = F.col("cluster_id").cast("bigint") * (1 << 32) + F.floor(F.col("column_index") / size)

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())} | threshold.pack(t["column_index"].to_numpy(), matrix(t["sig50"], EL_MATCH)))

    rows = members.where("n2_50 > 0").select(block.alias("block"), "column_index", "sig50")
    return rows.groupBy("block").applyInArrow(pack, "block bigint, ids binary, vectors binary")


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its Path class."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    """Data files under a version, and their sizes."""
    store, at = _store(spark, path)
    out, found, root = {}, store.listFiles(at(path), True), at(path).toUri().getPath().rstrip("/")
    while found.hasNext():
        f = found.next()
        name = f.getPath().toUri().getPath()[len(root) + 1 :]
        if not any(part.startswith(("_", ".")) for part in name.split("/")) and not name.startswith(MANIFEST):
            out[name] = f.getLen()
    return out


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions under a path, ascending."""
    store, at = _store(spark, path)
    if not store.exists(at(path)):
        return []
    names = [x.getPath().getName() for x in store.listStatus(at(path)) if x.isDirectory()]
    numbers = sorted(int(x[1:]) for x in names if x.startswith("v") and x[1:].isdigit())
    return [n for n in numbers if store.exists(at(f"{path}/v{n}/{MANIFEST}"))]


def save_index(index: Index, path: str, buckets: int = BUCKETS) -> int:
    """Write and publish a new version under the path; returns its number."""
    spark = index.members.sparkSession
    number = max(versions(spark, path), default=0) + 1
    work, width = f"{path}/v{number}", index.centroids.shape[1]
    store, at = _store(spark, path)
    store.delete(at(work), True)  # what a failed writer has left there was never published
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(index.centroids)], "cluster_id int, centroid array<double>").coalesce(1).write.parquet(f"{work}/centroids")
    spark.createDataFrame([(i, float(index.mean[i]), float(index.scale[i])) for i in range(width)], "dim int, mean double, scale double").coalesce(1).write.parquet(f"{work}/scaler")
    index.members.repartition("cluster_id").sortWithinPartitions("cluster_id", "column_index").write.parquet(f"{work}/members")
    table = f"namesieve_{uuid.uuid4().hex}"
    packed(index.members).repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block").option("path", f"{work}/blocks").saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the entry; the files stay
    about = {"n": index.n, "k": index.k, "max_size": index.max_size, "buckets": buckets, "files": _files(spark, work)}
    out = store.create(at(f"{work}/{MANIFEST}.new"), True)
    out.write(bytearray(json.dumps(about).encode()))
    out.close()
    if not store.rename(at(f"{work}/{MANIFEST}.new"), at(f"{work}/{MANIFEST}")):
        raise OSError(f"cannot publish version {number} under {path}")
    return number


def load_index(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The latest published version, or the one asked for."""
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no published {'index' if version is None else f'version {version}'} under {path}")
    work = f"{path}/v{version or known[-1]}"
    about = json.loads(spark.read.text(f"{work}/{MANIFEST}", wholetext=True).first().value)
    if (there := _files(spark, work)) != about["files"]:
        wrong = sorted(x for x in there.keys() | about["files"].keys() if there.get(x) != about["files"].get(x))
        raise ValueError(f"{work} is torn: {', '.join(wrong[:5])}")
    rows = sorted(spark.read.parquet(f"{work}/centroids").collect())
    mean, scale = scaler.collected(spark.read.parquet(f"{work}/scaler"))
    table = f"namesieve_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} (block BIGINT, ids BINARY, vectors BINARY) USING parquet CLUSTERED BY (block) SORTED BY (block) INTO {about['buckets']} BUCKETS LOCATION '{work}/blocks'")
    return Index(np.array([r.centroid for r in rows]), mean, scale, spark.read.parquet(f"{work}/members"), about["n"], about["max_size"], spark.table(table))
