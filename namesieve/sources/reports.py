"""Evaluation reports: small driver-side files, and Spark sinks for rows."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS, COUNTS = ["precision", "recall", "f1", "accuracy"], ["tp", "fp", "fn", "tn"]


def save_report(result: dict, folder: str, prefix: str) -> list[Path]:
    """<prefix>_result.json, _metrics.csv, _confusion.csv, and two plots where matplotlib is installed."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    files = [out / f"{prefix}_result.json"]
    files[0].write_text(json.dumps(result, indent=2, ensure_ascii=False, default=str))
    for part, head, names in (("metrics", "metric", METRICS), ("confusion", "count", COUNTS)):
        files.append(out / f"{prefix}_{part}.csv")
        with files[-1].open("w", newline="") as f:
            w = csv.writer(f)
            w.writerow([head, "value"])
            w.writerows([n, result[part][n]] for n in names)
        try:
            import matplotlib

            matplotlib.use("Agg")
            from matplotlib import pyplot
        except ImportError:
            continue
        figure, axes = pyplot.subplots()
        axes.bar(names, [result[part][n] for n in names])
        files.append(out / f"{prefix}_{part}.png")
        figure.savefig(files[-1])
        pyplot.close(figure)
    return files


def unpivoted(row: DataFrame, names: list[str], head: str) -> DataFrame:
    """(head, value) rows of a one-row table."""
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias(head), F.col(n).cast("double").alias("value")) for n in names))).alias("r")).select("r.*")


def save_rows(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Demo rows as JSON or CSV with a header."""
    rows.write.mode("overwrite").options(header=True).format(kind).save(path)


def sse(event: str, data: dict) -> str:
    """One server-sent event."""
    return f"event: {event}\ndata: {json.dumps(data, ensure_ascii=False, default=str)}\n\n"


def events(rows: DataFrame, step: int, name: str, party: str, data: list[str], timing_ms: float) -> DataFrame:
    """Step events: (event, step, name, party, data as JSON, timing_ms), one for each row."""
    return rows.select(F.lit("step").alias("event"), F.lit(step).alias("step"), F.lit(name).alias("name"), F.lit(party).alias("party"), F.to_json(F.struct(*data)).alias("data"), F.lit(timing_ms).alias("timing_ms"))
