"""Three-dimensional view of a clustered table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer



def project_3d(points: DataFrame, vector: str = "z", id_col: str = "id", cluster: str | None = "cluster_id", max_points: int = 300) -> DataFrame:
    """(id, cluster, x, y, z) of at most max_points rows, drawn by a hash of the id; axes reach from -1 to 1.

    The basis is that of the cluster means where there are three or more, else
    of the points drawn; only those and the overall mean come to the driver.
    Signs of axes are arbitrary.
    """
    rows = points.withColumn("_v", F.col(vector).cast("array<double>"))
    label = F.col(cluster).cast("bigint") if cluster else F.lit(None).cast("bigint")
    total = np.array(rows.select(Summarizer.mean(array_to_vector("_v")).alias("m")).first().m)
    centres = [r.m.toArray() for r in rows.groupBy(label.alias("c")).agg(Summarizer.mean(array_to_vector("_v")).alias("m")).collect()] if cluster else []
    drawn = sorted(rows.select(F.col(id_col).alias("i"), label.alias("c"), "_v").orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(max_points).collect())
    x = np.array([r._v for r in drawn]) - total
    base = np.array(centres) if len(centres) >= 3 else x
    _, axes = np.linalg.eigh(np.cov(base, rowvar=False))
    coords = x @ axes[:, -3:][:, ::-1]
    span = np.abs(coords).max(0)
    coords = coords / np.where(span < 1e-12, 1, span)
    return points.sparkSession.createDataFrame([(r.i, r.c, *map(float, c)) for r, c in zip(drawn, coords, strict=True)], "id bigint, cluster bigint, x double, y double, z double")


