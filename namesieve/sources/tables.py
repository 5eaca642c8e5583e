"""Written tables in the folder that driver and executors share, and samples that need no list on the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

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


def small_batches(spark: SparkSession) -> None:
    """Hold what goes to Python at once to a few MB, however wide the rows are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def bottom_k(rows: DataFrame, k: int, key: str, seed: int) -> DataFrame:
    """k rows without replacement: those with the least keyed hashes of `key`, in that order.

    Every task keeps its own k least and the driver merges them, so nothing
    grows with the rows; keys may be any numbers, with gaps.  The choice depends
    on keys and seed alone; of equal keys an arbitrary row is taken.
    """
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("bigint")), key).limit(k)
