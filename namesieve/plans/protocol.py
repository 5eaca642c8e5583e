"""Screening runs from names to judgements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cipher import Cipher, encrypted
from ..functions.minhash import batch_encode
from ..functions.vector import l2_normalise
from ..operators import scaler, search
from ..operators.index import Index, build_index
from ..params import EL_MATCH, Options


@dataclass
class Run:
    result: DataFrame
    debug: DataFrame
    index: Index


def run_queries(queries: DataFrame, names: DataFrame, options: Options = Options()) -> Run:
    """Screen all queries (query_id, name) against names (id, name); linear search is one cluster."""
    index = build_index(names, 1 if options.search == "linear" else options.k, options.seed)
    judged = search.screen(queries, index, options.tau, options.early_stop, options.nprobe)
    return Run(search.public(judged), judged, index)


def run_single_query(names: list[str], query: str, spark, options: Options = Options()) -> Run:
    table = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    return run_queries(spark.createDataFrame([(0, query)], "query_id bigint, name string"), table, options)


def query_vectors(queries: DataFrame, index: Index) -> DataFrame:
    """query_id, q200 (standardised with the list's scaler), q50 (unit length, never standardised)."""
    z = scaler.standardised(batch_encode(queries.select("query_id", "name")), index.mean, index.scale)
    return z.select("query_id", F.col("z").alias("q200"), l2_normalise(F.slice("sig", 1, EL_MATCH), F.col("n2_50")).alias("q50"))


def first_round(queries: DataFrame, index: Index, cipher: Cipher, name: str = "plain") -> tuple[DataFrame, DataFrame]:
    """(request for the other party, state that stays): the request never holds the matching vector."""
    v = query_vectors(queries, index)
    request = v.select("query_id", F.lit(bytearray(cipher.public_context())).alias("ctx"), encrypted(F.col("q200"), name).alias("ct200"))
    return request, v.select("query_id", encrypted(F.col("q50"), name).alias("ct50"))
