"""The two rounds on ciphertexts, as tables of messages between two parties.

The asking party holds the keys and sees decrypted scores; the answering party
holds the name list and never gets a key, a plain vector or the chosen cluster.

    first request    query_id, ct200
    first reply      query_id, scores        one ciphertext for each centroid
    second request   query_id, ct50, selector
    second reply     query_id, column_index, masked

A reply covers every column of the padded cluster matrix, so it does not tell
which cluster was chosen.  Columns and queries are both dealt into blocks, and
a task answers one block of queries on one block of columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from random import SystemRandom

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cipher import Key, backend, decrypted, encrypted, key_pair
from ..functions.minhash import matrix
from ..functions.vector import one_hot
from ..operators.index import Index
from ..operators.search import check_tau
from ..params import EL_MATCH, EPS, MASK_HIGH, MASK_LOW, TAU
from .protocol import query_vectors

COLUMNS, QUERIES = 64, 256


def valid_selector(selector: Column) -> Column:
    """The selector, if it is finite, holds zeros and ones only, and one 1; else an error."""
    finite = F.forall(selector, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    binary = F.forall(selector, lambda x: (x == 0.0) | (x == 1.0))
    total = F.aggregate(selector, F.lit(0.0), lambda s, x: s + x)
    return F.when(finite & binary & (F.abs(total - 1.0) < 1e-9), selector).otherwise(F.raise_error(F.lit("a selector must be one-hot")).cast("array<double>"))


def best_cluster(scores: Column, k: int) -> Column:
    """Position of the greatest of k finite scores, the first of those that differ by rounding errors alone."""
    scores = F.transform(scores, lambda x: F.round(x, 10))
    good = (F.size(scores) == k) & F.forall(scores, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.array_position(scores, F.array_max(scores)).cast("int") - 1).otherwise(F.raise_error(F.lit("scores must be one finite number for each cluster")).cast("int"))


def first_reply(request: DataFrame, centroids: np.ndarray, name: str | Key = "plain") -> DataFrame:
    """The answering party: a score ciphertext of each centroid."""
    def run(batches):
        cipher = backend(name)
        for batch in batches:
            scores = [[cipher.dot_plain(ct, c) for c in centroids] for ct in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"query_id": batch.column(0), "scores": pa.array(scores, pa.list_(pa.binary()))})

    return request.select("query_id", "ct200").mapInArrow(run, "query_id bigint, scores array<binary>")


def decrypted_scores(reply: DataFrame, name: str | Key = "plain") -> DataFrame:
    """The asking party: query_id, scores in the clear."""
    def run(batches):
        cipher = backend(name)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"query_id": batch.column(0), "scores": pa.array([[float(cipher.decrypt(x)[0]) for x in row] for row in batch.column(1).to_pylist()], pa.list_(pa.float64()))})

    return reply.select("query_id", "scores").mapInArrow(run, "query_id bigint, scores array<double>")


def second_request(scores: DataFrame, state: DataFrame, k: int, name: str | Key = "plain") -> tuple[DataFrame, DataFrame]:
    """(request, what stays: query_id, selected_cluster) from decrypted scores and the state (query_id, ct50)."""
    chosen = scores.select("query_id", best_cluster(F.col("scores"), k).alias("selected_cluster"))
    selector = encrypted(valid_selector(one_hot(F.col("selected_cluster"), k)), name)
    return state.join(chosen, "query_id").select("query_id", "ct50", selector.alias("selector")), chosen


def second_reply(request: DataFrame, members: DataFrame, k: int, max_size: int, tau: float = TAU, name: str | Key = "plain", columns: int = COLUMNS, queries: int = QUERIES) -> DataFrame:
    """The answering party: mask x (score - tau) of every column; a fresh mask for each.

    members: cluster_id, column_index, sig50, n2_50; missing ones are zero vectors.
    """
    check_tau(tau)
    wide = -(-max_size // columns)
    deep = -(-request.count() // queries) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = members.select("cluster_id", "column_index", "sig50", "n2_50", F.floor(F.col("column_index") / columns).cast("int").alias("c"), each(deep).alias("q"))
    right = request.select("query_id", "ct50", "selector", F.pmod(F.xxhash64("query_id"), F.lit(deep)).cast("int").alias("q"), each(wide).alias("c"))

    def answer(x: pa.Table, y: pa.Table) -> pa.Table:
        cipher, source, out = backend(name), SystemRandom(), {"query_id": [], "column_index": [], "masked": []}
        if x.num_rows and y.num_rows:
            first = x["c"][0].as_py() * columns
            n = min(columns, max_size - first)
            block = np.zeros((n, k, EL_MATCH))
            root = np.sqrt(x["n2_50"].to_numpy().astype(np.float64))
            block[x["column_index"].to_numpy() - first, x["cluster_id"].to_numpy()] = matrix(x["sig50"], EL_MATCH) / np.where(root == 0, 1, root)[:, None]
            for i, ct50, selector in zip(y["query_id"].to_pylist(), y["ct50"].to_pylist(), y["selector"].to_pylist(), strict=True):
                for j in range(n):
                    score = cipher.dot(cipher.matmul_plain(selector, block[j]), ct50)
                    mask = np.array([source.uniform(MASK_LOW, MASK_HIGH)])
                    out["query_id"].append(i)
                    out["column_index"].append(first + j)
                    out["masked"].append(cipher.mul_plain(cipher.add_plain(score, np.array([-tau])), mask))
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "column_index": pa.array(out["column_index"], pa.int64()), "masked": pa.array(out["masked"], pa.binary())})

    return left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInArrow(answer, "query_id bigint, column_index bigint, masked binary")


def judged(reply: DataFrame, max_size: int, early_stop: bool = True, name: str | Key = "plain") -> DataFrame:
    """The asking party: query_id, catch, first_positive_column, checked_columns; only query_id and catch are the result."""
    def clear(data: pd.Series) -> pd.Series:
        cipher = backend(name)
        return data.map(lambda x: float(cipher.decrypt(bytes(x))[0]))

    score = F.pandas_udf(clear, "double")(F.col("masked"))
    first = reply.select("query_id", "column_index", score.alias("score")).groupBy("query_id").agg(F.min(F.when(F.col("score") > EPS, F.col("column_index"))).alias("first_positive_column"))
    catch = F.col("first_positive_column").isNotNull()
    checked = F.when(F.lit(early_stop) & catch, F.col("first_positive_column") + 1).otherwise(F.lit(max_size))
    return first.select("query_id", catch.alias("catch"), "first_positive_column", checked.cast("bigint").alias("checked_columns"))


@dataclass
class Rounds:
    """result: query_id, catch; debug: the columns that stay with the asking party; messages: query_id, sent and received bytes."""

    result: DataFrame
    debug: DataFrame
    messages: DataFrame


def run_rounds(vectors: DataFrame, centroids: np.ndarray, members: DataFrame, max_size: int, tau: float = TAU, early_stop: bool = True, name: str | tuple[Key, Key] = "plain") -> Rounds:
    """Both rounds for vectors (query_id, q200, q50); name: a scheme, or a pair of keys (secret, public)."""
    secret, public = name if isinstance(name, tuple) else key_pair(name)
    request = vectors.select("query_id", encrypted(F.col("q200"), secret).alias("ct200"))
    state = vectors.select("query_id", encrypted(F.col("q50"), secret).alias("ct50"))
    reply = first_reply(request, centroids, public)
    second, chosen = second_request(decrypted_scores(reply, secret), state, len(centroids), secret)
    answers = second_reply(second, members, len(centroids), max_size, tau, public)
    debug = judged(answers, max_size, early_stop, secret).join(chosen, "query_id")
    size = lambda c: F.octet_length(c).cast("long")
    sent = request.select("query_id", size("ct200").alias("sent"), F.lit(0).cast("long").alias("received")).union(second.select("query_id", size("ct50") + size("selector"), F.lit(0).cast("long")))
    received = reply.select("query_id", F.lit(0).cast("long"), F.aggregate("scores", F.lit(0).cast("long"), lambda s, x: s + size(x))).union(answers.select("query_id", F.lit(0).cast("long"), size("masked")))
    messages = sent.union(received).groupBy("query_id").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received"))
    return Rounds(debug.select("query_id", "catch"), debug, messages)


def run_encrypted(queries: DataFrame, index: Index, tau: float = TAU, early_stop: bool = True, name: str | tuple[Key, Key] = "plain") -> Rounds:
    """Both rounds for queries (query_id, name) against an index."""
    return run_rounds(query_vectors(queries, index), index.centroids, index.members, index.max_size, tau, early_stop, name)


__all__ = ["Rounds", "best_cluster", "decrypted", "decrypted_scores", "first_reply", "judged", "run_encrypted", "run_rounds", "second_reply", "second_request", "valid_selector"]
