"""Confusion counts, metrics, verdicts, byte accounting, error statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    p, y = F.col(predicted), F.col(label)
    return rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def metrics(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, accuracy; 0 where the denominator is."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    return counts.select(precision.alias("precision"), recall.alias("recall"), _share(2 * precision * recall, precision + recall).alias("f1"), _share(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def verdict(catch: Column, hit_name: Column, expected_hit: Column, expected_label: Column) -> Column:
    """True where the expected name was found, or nothing where nothing was expected; null without an expectation."""
    return F.when(expected_hit.isNotNull(), catch & hit_name.eqNullSafe(expected_hit)).when(~expected_label, ~catch)


def accuracy(verdicts: DataFrame, column: str = "correct") -> DataFrame:
    """Share of true verdicts among those given; null if none is."""
    return verdicts.agg(F.try_divide(F.count_if(F.col(column)).cast("double"), F.count(column)).alias("accuracy"))


def communication(messages: DataFrame, sent: list[str], received: list[str]) -> DataFrame:
    """MiB in each direction and in all, from binary or text columns of one row a query."""
    size = lambda cs: sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in cs), F.lit(0)) / float(1 << 20)
    return messages.agg(size(sent).alias("sent_mb"), size(received).alias("received_mb"), size(sent + received).alias("total_mb"))


#: Values that come to the driver at the end of a selection.
_FEW = 10_000


def ranked_value(rows: DataFrame, column: str, rank: int) -> float:
    """The value of this rank (from 0) among those that are neither null nor NaN, exact, in a few scans.

    Each scan brackets the rank by approximate percentiles, sketches of bounded
    size, and counts what lies below and at the ends of the bracket; the next
    one looks at what is strictly inside.  No task or buffer holds more than a
    sketch or, at the end, a few thousand values; repeated values end it at once.
    """
    inside = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).select(F.col(column).cast("double").alias("x"))
    n = inside.count()
    if not 0 <= rank < n:
        raise ValueError(f"no rank {rank} among {n} values")
    while n > _FEW:
        share, slack = (rank + 0.5) / n, 2e-3
        ends = inside.agg(F.percentile_approx("x", [max(share - slack, 0.0), min(share + slack, 1.0)], F.lit(1000)).alias("p")).first().p
        low, high = ends
        x = F.col("x")
        below, at_low, between, at_high = inside.agg(F.count_if(x < low), F.count_if(x == low), F.count_if((x > low) & (x < high)), F.count_if((x == high) & (x > low))).first()
        if rank < below:  # the sketch was too coarse: everything below the bracket
            inside, n = inside.where(x < low), below
        elif rank < below + at_low:
            return low
        elif rank < below + at_low + between:
            inside, rank, n = inside.where((x > low) & (x < high)), rank - below - at_low, between
        elif rank < below + at_low + between + at_high:
            return high
        else:
            inside, rank, n = inside.where(x > high), rank - below - at_low - between - at_high, n - below - at_low - between - at_high
    return sorted(r.x for r in inside.collect())[rank]


def median(rows: DataFrame, column: str) -> float | None:
    """The exact median of all values that are neither null nor NaN; the mean of the middle two; null without any."""
    n = rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return None
    low = ranked_value(rows, column, (n - 1) // 2)
    if n % 2:
        return low
    x = F.col(column).cast("double")
    upto, above = rows.where(~F.isnan(x)).agg(F.count_if(x <= low), F.min(F.when(x > low, x))).first()
    return (low + (low if upto > n // 2 else above)) / 2


def error_statistics(rows: DataFrame, error: str) -> DataFrame:
    """Mean, population deviation, greatest value and exact median."""
    return rows.agg(F.avg(error).alias("mean"), F.stddev_pop(error).alias("std"), F.max(error).alias("max")).withColumn("median", F.lit(median(rows, error)).cast("double"))
