"""End-to-end evaluation of a data set."""

from __future__ import annotations

import functools
import resource
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..cipher import encrypted, key_pair
from ..operators import metrics
from ..operators.index import build_index
from ..params import EL_CLUSTER, EL_MATCH, SEED, TAU
from ..sources.datasets import load_dataset
from . import rounds
from .protocol import query_vectors

DEFAULTS = {"dataset": "ncvr_10k", "data_path": "", "el_cluster": EL_CLUSTER, "el_match": EL_MATCH, "k": None, "k_mode": "sqrt", "tau": TAU, "query_limit": -1, "db_limit": -1, "use_mock": False, "early_stop": True, "reuse_context": True, "seed": SEED, "cipher": "plain"}


class StageTimer:
    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began


def timed(run: Callable) -> Callable:
    """A function that returns (result, seconds)."""
    @functools.wraps(run)
    def wrapped(*args, **kwargs):
        began = time.perf_counter()
        out = run(*args, **kwargs)
        return out, time.perf_counter() - began

    return wrapped


def benchmark(spark: SparkSession, config: dict) -> dict:
    """Metrics, confusion counts, times, measured bytes and peak memory of one configuration.

    All queries go through both rounds on ciphertexts as rows of one job each;
    avg_round1 and avg_round2 are seconds a query.  reuse_context counts the
    public context once, else once a query.
    """
    c = DEFAULTS | config
    if unknown := set(config) - set(DEFAULTS):
        raise ValueError(f"unknown options: {sorted(unknown)}")
    if (c["el_cluster"], c["el_match"]) != (EL_CLUSTER, EL_MATCH):
        raise ValueError(f"signatures have {EL_CLUSTER} and {EL_MATCH} numbers")
    timer = StageTimer()
    queries, names = load_dataset(spark, c["dataset"], c["data_path"], c["query_limit"], c["db_limit"])
    with timer.stage("offline"):
        index = build_index(names, c["k"] or c["k_mode"], c["seed"])
    (secret, public), k = key_pair(c["cipher"]), index.k
    held = []

    def keep(df):
        held.append(df.cache())
        return held[-1]

    try:
        with timer.stage("round1"):
            vectors = keep(query_vectors(queries, index))
            request = keep(vectors.select("query_id", encrypted(F.col("q200"), secret).alias("ct200")))
            state = vectors.select("query_id", encrypted(F.col("q50"), secret).alias("ct50"))
            reply = keep(rounds.first_reply(request, index.centroids, public))
            second, _ = rounds.second_request(rounds.decrypted_scores(reply, secret), state, k, secret)
            n = keep(second).count()
        with timer.stage("round2"):
            answers = keep(rounds.second_reply(second, index.members, k, index.max_size, c["tau"], public))
            debug = rounds.judged(answers, index.max_size, c["early_stop"], secret)
            judged = keep(debug.join(queries.select("query_id", "label"), "query_id").withColumnRenamed("catch", "predicted"))
            counts = keep(metrics.confusion(judged))
            confusion = counts.first().asDict()
        size = lambda df, *cols: df.agg(F.sum(sum(F.octet_length(x) for x in cols))).first()[0] or 0
        context = len(public.context) * (1 if c["reuse_context"] else n)
        sent = context + size(request, "ct200") + size(second, "ct50", "selector")
        checked = answers.join(judged.select("query_id", "checked_columns"), "query_id").where("column_index < checked_columns")
        received = size(reply.select(F.explode("scores").alias("x")), "x") + size(checked, "masked")
        seconds = timer.seconds
        return {
            "config": c,
            "metrics": metrics.metrics(counts).first().asDict(),
            "confusion": confusion,
            "timing_sec": {"offline": seconds["offline"], "online_total": seconds["round1"] + seconds["round2"], "avg_round1": seconds["round1"] / max(n, 1), "avg_round2": seconds["round2"] / max(n, 1)},
            "communication_mb": {"sent": sent / 2**20, "recv": received / 2**20, "total": (sent + received) / 2**20},
            "memory_peak_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024,
        }
    finally:
        for df in held:
            df.unpersist()
        index.release()
