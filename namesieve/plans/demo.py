"""Demonstrations: rows of a protocol run, step events, and their summary."""

from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics
from ..operators.index import build_index, cluster_sizes, size_summary
from ..operators.search import first_hit
from ..params import TAU
from . import rounds

# The names of the standard demonstration, each with a misspelt form, and names that are not listed.
PAIRS = [
    ("JAMES MICHAEL AARON", "JAMES MICHAEL ARON"),
    ("TIMOTHY DUANE AARMSTRONG", "TIMOTHY DUANE ARMSTRONG"),
    ("NATHAN EDWARD AARON", "NATHAN EDWARD AARO"),
    ("JOY GAYLE ABAZIED COOPER", "JOY GAYL ABAZIED COOPER"),
    ("HAROLD GRANT ABBOTT", "HAROLD GRNT ABBOTT"),
]
NEGATIVES = ["DAVID ALLEN BLACK", "DEBORAH ELAINE BLACK", "DONNA WEST BLACK"]
COLUMNS = ["query_index", "query_name", "expected_label", "predicted_match", "selected_cluster", "selected_cluster_size", "first_positive_column", "matched_database_index", "matched_name", "checked_columns", "round1_sec", "round2_sec", "total_sec"]


def demo_queries(spark: SparkSession) -> DataFrame:
    """query_id, name, label, expected: every name followed by its misspelt form, then names that must not be found."""
    rows = [(name, True, right) for right, wrong in PAIRS for name in (right, wrong)] + [(name, False, None) for name in NEGATIVES]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "query_id bigint, name string, label boolean, expected string")


def steps(queries: DataFrame, names: DataFrame, k: int | str = 10, tau: float = TAU, early_stop: bool = True, name: str = "plain") -> Iterator[dict]:
    """Events of a run, each as soon as its step is done, then one with the summary and the demonstration's rows.

    queries: query_id, name, label and, on demand, expected (the name to find).
    All queries go through each step together; times a query are means.
    """
    from ..cipher import encrypted, key_pair
    from .protocol import query_vectors

    held: list[DataFrame] = []
    began = last = time.perf_counter()
    number = 0

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.cache())
        return held[-1]

    def event(step: str, party: str, **data) -> dict:
        nonlocal last, number
        now = time.perf_counter()
        number, spent, last = number + 1, now - last, now
        return {"event": "step_complete", "step": number, "name": step, "party": party, "data": data, "timing_ms": 1000 * spent}

    secret, public = key_pair(name)
    index = build_index(names, k)
    sizes = size_summary(cluster_sizes(index.members, index.k)).first()
    try:
        yield (offline := event("offline preparation", "B", records=index.n, clusters=index.k, least=sizes.least, most=sizes.most, mean=sizes["mean"]))
        vectors = keep(query_vectors(queries, index))
        request = keep(vectors.select("query_id", encrypted(F.col("q200"), secret).alias("ct200")))
        n = request.count()
        yield (asked := event("first request", "A", queries=n, bytes=request.agg(F.sum(F.octet_length("ct200"))).first()[0] or 0))
        reply = keep(rounds.first_reply(request, index.centroids, public))
        yield (scored := event("centroid scores", "B", ciphertexts=reply.agg(F.sum(F.size("scores"))).first()[0] or 0))
        state = vectors.select("query_id", encrypted(F.col("q50"), secret).alias("ct50"))
        second, chosen = rounds.second_request(rounds.decrypted_scores(reply, secret), state, index.k, secret)
        chosen = keep(chosen)
        yield (picked := event("second request", "A", queries=keep(second).count()))
        answers = keep(rounds.second_reply(second, index.members, index.k, index.max_size, tau, public))
        yield (matched := event("column scores", "B", ciphertexts=answers.count()))
        debug = keep(rounds.judged(answers, index.max_size, early_stop, secret).join(chosen, "query_id"))
        caught = debug.where("catch").count()
        yield (last_step := event("judgement", "A", caught=caught))

        share = [sum(e["timing_ms"] for e in part) / 1000 / max(n, 1) for part in ((asked, scored, picked), (matched, last_step))]
        found = first_hit(debug, index.members).join(cluster_sizes(index.members, index.k).withColumnRenamed("cluster_id", "selected_cluster"), "selected_cluster")
        rows = queries.join(found, "query_id").select(F.col("query_id").alias("query_index"), F.col("name").alias("query_name"), F.col("label").alias("expected_label"), F.col("catch").alias("predicted_match"), "selected_cluster", F.col("n").alias("selected_cluster_size"), "first_positive_column", F.col("matched_id").alias("matched_database_index"), "matched_name", "checked_columns", *([F.col("expected")] if "expected" in queries.columns else []))
        rows = rows.withColumns({"round1_sec": F.lit(share[0]), "round2_sec": F.lit(share[1]), "total_sec": F.lit(sum(share))})
        expected = F.col("expected") if "expected" in queries.columns else F.lit(None).cast("string")
        right = metrics.accuracy(rows.select(metrics.verdict(F.col("predicted_match"), F.col("matched_name"), expected, F.col("expected_label")).alias("correct"))).first().accuracy
        timing = {"offline_preprocessing": offline["timing_ms"] / 1000, "online_queries": sum(share) * n, "total": time.perf_counter() - began}
        yield {"event": "complete", "summary": {"queries": n, "caught": caught, "accuracy": right, "timing_sec": timing}, "rows": [r.asDict() for r in rows.select(*COLUMNS).orderBy("query_index").collect()]}
    finally:
        for df in held:
            df.unpersist()
        index.release()
