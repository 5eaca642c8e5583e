"""An index in SQL: a table function that probes it, and its members as a view.

    SELECT p.query_id, min(m.column_index) AS first_positive_column
    FROM names_probe(TABLE(asked)) p
    LEFT JOIN names_members m ON m.cluster_id = p.cluster_id
         AND minhash_cosine(p.q50, m.sig50) - 0.9 > 1e-6
    GROUP BY p.query_id

The table function takes Arrow batches of (query_id, name) and gives for each
name that is not null its cluster, in the place where the batch is; the join is
Spark's own.  What a task is given is the centroids and the scaler.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.minhash import signatures_of
from ..functions.text import cleaned
from ..functions.vector import register
from ..operators.index import Index
from ..operators.kmeans import nearest
from ..operators.scaler import unit_rows
from ..params import EL_MATCH


def register_index(spark: SparkSession, index: Index, name: str = "names") -> None:
    """Temporary view {name}_members, table function {name}_probe, and the SQL functions of names and signatures."""
    register(spark)
    index.members.createOrReplaceTempView(f"{name}_members")
    centroids, mean, scale = index.centroids, index.mean, index.scale

    @F.arrow_udtf(returnType="query_id bigint, cluster_id int, q50 array<bigint>, q2 bigint")
    class Probe:
        """The cluster of each name of a batch (query_id, name)."""

        def eval(self, batch: pa.RecordBatch):
            known = batch.filter(batch.column("name").is_valid())
            sig = signatures_of(pa.array([cleaned(x) for x in known.column("name").to_pylist()], pa.string()))
            best, _ = nearest((unit_rows(sig) - mean) / scale, centroids) if len(sig) else (np.zeros(0, np.int64), None)
            head = np.ascontiguousarray(sig[:, :EL_MATCH])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(head) + 1, dtype=np.int32) * EL_MATCH), pa.array(head.ravel()))
            yield pa.table({"query_id": known.column("query_id").cast(pa.int64()), "cluster_id": pa.array(best.astype(np.int32)), "q50": lists, "q2": pa.array((head * head).sum(1))})

    spark.udtf.register(f"{name}_probe", Probe)
