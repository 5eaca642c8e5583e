"""Per-dimension standardisation of L2-normalised signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.minhash import matrix
from ..params import EL_CLUSTER

#: Rows of a batch that are held as doubles at a time.
ROWS = 1024


def unit_rows(sig: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    norm = np.sqrt((sig * sig).sum(1, keepdims=True))
    return sig / np.where(norm == 0, 1, norm)


def fit_scaler(encoded: DataFrame, width: int = EL_CLUSTER, weight: str | None = None) -> DataFrame:
    """(dim, mean, scale): mean and population deviation of each dimension of the unit rows; scale 1 for a constant one; weight: a column with the number of times that a row counts.

    Each stretch of a batch sends one row of partial sums to the aggregate (Chan's formula joins them), not its rows x dimensions.
    """
    def partial(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x = unit_rows(matrix(part.column(0), width))
                w = np.ones(len(x), np.int64) if weight is None else part.column(1).to_numpy()
                mean = w @ x / w.sum()
                yield pa.RecordBatch.from_pydict({"dim": pa.array(np.arange(width, dtype=np.int32)), "n": pa.array(np.full(width, w.sum())), "m": pa.array(mean), "q": pa.array(w @ (x - mean) ** 2)})

    parts = encoded.select("sig", *([] if weight is None else [F.col(weight).cast("bigint")])).mapInArrow(partial, "dim int, n bigint, m double, q double")
    total = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("q")).alias("q"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("b"))
    mean = F.col("s") / F.col("n")
    variance = F.greatest((F.col("q") + F.col("b") - F.col("n") * mean * mean) / F.col("n"), F.lit(0.0))
    return total.select("dim", mean.alias("mean"), F.when(variance < 1e-20, 1.0).otherwise(F.sqrt(variance)).alias("scale"))


def collected(scaler: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and scale as vectors; one row for each dimension comes to the driver."""
    rows = sorted(scaler.collect())
    return np.array([r.mean for r in rows]), np.array([r.scale for r in rows])


def standardised(encoded: DataFrame, mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    """The rows with their standardised unit vector `z`."""
    kept = encoded.columns
    width = len(mean)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                z = (unit_rows(matrix(part.column("sig"), width)) - mean) / scale
                yield pa.RecordBatch.from_pydict({c: part.column(c) for c in kept} | {"z": pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * width), pa.array(z.ravel()))})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, z array<double>")
