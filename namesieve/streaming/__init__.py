"""Screening of queries that arrive as a stream.

With a memory, names that were judged before are answered from it: a table of
verdicts by batch, read up to the batch before, so that a batch that comes again
after a failure sees what it saw, overwrites what it wrote, and gives the same
answers.  Names are compared as cleaned, a name that comes several times in a
batch is screened once, and verdicts older than the time to live are not used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import clean_name
from ..operators import search
from ..operators.index import Index
from ..params import TAU
from ..sources.tables import written

VERDICTS = "clean string, catch boolean, judged_at timestamp, batch long"


def remembered(df: DataFrame, index: Index, memory: str, number: int, ttl_seconds: float, tau: float = TAU) -> DataFrame:
    """(query_id, catch, known) of a batch (query_id, name); known: answered from the memory. New verdicts are written to it as this batch's."""
    spark = df.sparkSession
    asked = written(df.where(F.col("name").isNotNull()).select("query_id", clean_name(F.col("name")).alias("clean")))
    spark.createDataFrame([], VERDICTS).drop("batch").write.mode("overwrite").parquet(f"{memory}/batch=-1")  # so that there is a table
    before = spark.read.schema(VERDICTS).parquet(memory).where((F.col("batch") < number) & (F.col("judged_at") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))))
    seen = written(before.join(asked.select("clean").distinct(), "clean", "left_semi").groupBy("clean").agg(F.max_by("catch", F.struct("batch", "judged_at")).alias("catch")))
    new = written(asked.select("clean").distinct().join(seen, "clean", "left_anti").select(F.monotonically_increasing_id().alias("query_id"), F.col("clean").alias("name")))
    judged = search.public(search.screen(new, index, tau)).join(new, "query_id").select(F.col("name").alias("clean"), "catch", F.current_timestamp().alias("judged_at"))
    judged.write.mode("overwrite").parquet(f"{memory}/batch={number}")
    mine = spark.read.schema(VERDICTS).parquet(memory).where(F.col("batch") == number)
    verdicts = seen.select("clean", "catch", F.lit(True).alias("known")).union(mine.select("clean", "catch", F.lit(False)))
    return asked.join(verdicts, "clean").select("query_id", "catch", "known")


def screen_stream(arriving: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, tau: float = TAU, early_stop: bool = True, once: bool = False, memory: str | None = None, ttl_seconds: float = 86_400) -> StreamingQuery:
    """Screen each micro-batch of (query_id, name) against the index and hand (query_id, catch) to the sink with its batch number.

    A batch number comes again after a failure, so a sink that overwrites by it
    delivers exactly once.  memory: a folder for verdicts, kept for ttl_seconds.
    """
    def batch(df: DataFrame, number: int) -> None:
        if memory is None:
            sink(search.public(search.screen(df, index, tau, early_stop)), number)
        else:
            sink(remembered(df, index, memory, number, ttl_seconds, tau).select("query_id", "catch"), number)

    writer = arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
