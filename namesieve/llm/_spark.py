"""Small helpers around the session: shared folder, written tables, components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one, gone at exit, only in local mode where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="namesieve-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """The same rows from a table in the shared folder: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    (df if partitions is None else df.coalesce(partitions)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(name: str, taken: list[str]) -> str:
    """A column name like `name` that clashes with none of those taken."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def careful(spark: SparkSession) -> None:
    """Hold what goes to Python at once to a few MB, however long the texts are."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= 2000:
        spark.conf.set(rows, "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def tidy(keep_encoder: bool = False) -> None:
    """Give memory that this Python worker no longer needs back to the system; workers live on between tasks."""
    tokens = sys.modules.get("namesieve.llm.tokens")
    if tokens and not keep_encoder:
        tokens.encoder.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable, keep_encoder: bool = False) -> Callable:
    """A function of Arrow batches that tidies up before and after its partition."""
    def tidied(batches):
        tidy(keep_encoder)
        yield from run(batches)
        tidy(keep_encoder)

    return tidied


def slots(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def by_volume(docs: DataFrame, text_col: str = "text", chars: int = 1 << 26) -> int:
    """Partitions for a range sort of texts: spark.sql.shuffle.partitions, or more, so that none holds much over `chars` characters, however large the corpus is."""
    total = docs.agg(F.sum(F.length(text_col)).alias("n")).first().n or 0
    return min(max(slots(docs.sparkSession), -(-total // chars)), 100_000)


def identified(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a column that tells its rows apart, and that column's name.

    It is the doc_id where every row has one of its own; else a number given
    once, in a written table, so that rows that share a doc_id or have none
    are never taken for each other.
    """
    key, ids = free("row", docs.columns), F.col(id_col).cast("long")
    size = docs.agg(F.count("*").alias("n"), F.count_distinct(ids).alias("distinct")).first()
    if size.n == size.distinct:
        return docs.withColumn(key, ids), key
    return written(docs.withColumn(key, F.monotonically_increasing_id())), key


def spread_join(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows joined with values, which has each key once; no null keys.  rows is read three times, so it should be a written table.

    A key with over a thousandth of the rows, of which there are fewer than a
    thousand, is joined by broadcast; all others are shuffled, so that no task
    gets more than a thousandth for any key.
    """
    size = rows.count()
    hot = written(rows.groupBy(key).count().where(F.col("count") * 1000 > size).select(key).join(values, key), 1)
    often = rows.join(F.broadcast(hot), key)
    return often.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(values, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of the links (a, b); comp is the least node that a chain of links reaches.

    Alternating large-star and small-star rounds: each is one minimum by key,
    combined before the shuffle, and one equi-join, so no neighbour list is
    ever held in one place.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    for _ in range(60):
        both = e.union(e.select(F.col("v"), F.col("u")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u <> v").distinct())
        small = large.join(least(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct())
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError("connected components did not settle in 60 rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
