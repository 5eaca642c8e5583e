"""Vector expressions over array columns."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..params import EL_MATCH
from .minhash import signature, signatures_of
from .text import SPACE, _nfkc, clean_name, cleaned


def dot(x: Column, y: Column) -> Column:
    """Dot product; exact for BIGINT signatures."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, v: s + v)


def cosine(xy: Column, xx: Column, yy: Column) -> Column:
    """Cosine from a dot product and squared norms; 0 for a zero vector."""
    return F.when((xx == 0) | (yy == 0), 0.0).otherwise(xy / (F.sqrt(xx) * F.sqrt(yy)))


def l2_normalise(x: Column, xx: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return F.when(xx == 0, x.cast("array<double>")).otherwise(F.transform(x, lambda v: v / F.sqrt(xx)))


def standardise(x: Column, mean: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(x, mean, lambda a, b: a - b), scale, lambda a, b: a / b)


def one_hot(position: Column, k: int) -> Column:
    """Vector of k elements with 1 at the position; positions outside 0..k-1 and nulls fail."""
    good = position.isNotNull() & (position >= 0) & (position < k)
    return F.when(good, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == position, 1.0).otherwise(0.0))).otherwise(F.raise_error(F.lit("selector position out of range")).cast("array<double>"))


def _minhash(s: pd.Series) -> pd.Series:
    """Signatures of names; null stays null."""
    known = s.notna()
    clean = s[known].map(cleaned)
    found = iter(signatures_of(pa.array(clean, pa.string()))[:, :EL_MATCH]) if len(clean) else iter(())
    return pd.Series([next(found) if x else None for x in known], dtype=object)


def register(spark: SparkSession) -> None:
    """SQL functions clean_name, minhash (Arrow batches) and minhash_cosine; texts beyond ASCII are normalised in Arrow batches."""
    spark.udf.register("nfkc", F.pandas_udf(_nfkc, "string"))
    space, ascii_only = SPACE.replace("\\", "\\\\"), r"[^\\x00-\\x7f]"
    whole = f"CASE WHEN s RLIKE '{ascii_only}' THEN nfkc(s) ELSE s END"
    text = f"trim(regexp_replace(regexp_replace(lower({whole}), '[^a-z{space}]', ''), '[{space}]+', ' '))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION clean_name(s STRING) RETURNS STRING RETURN {text}")
    spark.udf.register("minhash", F.pandas_udf(_minhash, "array<bigint>"))
    pair = "aggregate(zip_with({0}, {1}, (p, q) -> p * q), 0L, (a, v) -> a + v)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION minhash_cosine(x ARRAY<BIGINT>, y ARRAY<BIGINT>) RETURNS DOUBLE RETURN coalesce(try_divide({pair.format('x', 'y')}, sqrt({pair.format('x', 'x')}) * sqrt({pair.format('y', 'y')})), 0.0D)")


__all__ = ["clean_name", "cosine", "dot", "l2_normalise", "one_hot", "register", "signature", "standardise"]
