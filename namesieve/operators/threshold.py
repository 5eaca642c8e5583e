"""Exact cosine threshold join of signatures, with bounds that leave most pairs out.

Equal signatures become one row on both sides.  PIVOTS rows of the list are
drawn; every row belongs to the ball of its nearest pivot, in a ring of angles
around it, and rings are cut into blocks (or blocks are cut from clusters that
are given).  A block keeps a centre and a radius, and the least and greatest
angle of its rows to each pivot.  An angle is a metric: a query that is further
from a block's ball, or from its range of angles to some pivot, than the
threshold's angle has no hit in it, and is not sent there.  Where a block and its queries meet, the
products over the block's HEAD heaviest dimensions come first; what is left of
both vectors bounds the rest (Cauchy-Schwarz), and only pairs that can still
reach the threshold are multiplied in full.  Bounds carry a slack far above
rounding errors, and full products of signatures are exact, so hits are those
of comparing all pairs.

What the driver and every task hold is the pivots and the ranges of at most
about MOST_BLOCKS blocks, some 10 MB whatever the list's size; blocks grow
instead.  A block that many queries reach is copied, so that its queries are
spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.minhash import matrix
from ..params import EL_MATCH, EPS, SEED, TAU
from ..sources.tables import bottom_k, small_batches, written

PIVOTS, RING, HEAD = 64, 0.2, 12
BLOCK, MOST_BLOCKS = 2048, 1 << 14
#: Packed rows of queries that one copy of a block meets.
MEETS = 64
#: Angles between queries and blocks that are held at a time.
REACH = 1 << 20
#: Radians and cosines by which bounds are loosened.
SLACK = 1e-6


def check_tau(tau: float) -> None:
    """Padding columns score -mask x tau, so a threshold that is not positive would catch them."""
    if not tau > 0:
        raise ValueError(f"tau must be positive, got {tau}")


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of each row of x to each of the unit rows of centres."""
    return np.arccos(np.clip(unit(x) @ centres.T, -1.0, 1.0))


def distinct(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, v): each signature that is not zero once, with the least id that has it."""
    return rows.where("n2_50 > 0").groupBy(F.slice("sig", 1, EL_MATCH).alias("v")).agg(F.min(id_col).alias("id")).select(F.col("id").cast("bigint"), "v")


@dataclass
class Bounds:
    """Numbers, balls and ranges of angles to the pivots, a row a block."""

    pivots: np.ndarray
    block: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def reached(self, x: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, place of a block) wherever neither the ball nor a range of angles rules a hit out."""
        step = max(1, REACH // max(len(self.block), 1))
        near = [np.nonzero(angles(x[a : a + step], self.centre) <= self.radius + limit) for a in range(0, len(x), step)]  # a bounded product at a time
        q, b = (np.concatenate([r + i * step * (side == 0) for i, r in enumerate(z)]) if near else np.zeros(0, np.int64) for side, z in enumerate(zip(*near) if near else ((), ())))
        theta = angles(x, self.pivots)
        for a in range(0, len(q), 1 << 14):
            part = slice(a, a + (1 << 14))
            t = theta[q[part]]
            near = ((t >= self.low[b[part]] - limit) & (t <= self.high[b[part]] + limit)).all(1)
            b[part] = np.where(near, b[part], -1)
        return q[b >= 0], b[b >= 0]


@dataclass
class Blocks:
    """table: block, ids, vectors (packed); bounds: the driver's copy of what each block is known by."""

    table: DataFrame
    bounds: Bounds


def pack(ids: np.ndarray, x: np.ndarray) -> dict[str, pa.Array]:
    return {"ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "vectors": pa.array([x.astype(np.int32).tobytes()], pa.binary())}


def _unpack(ids: pa.Scalar, vectors: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids.as_py(), np.int64), np.frombuffer(vectors.as_py(), np.int32).reshape(-1, EL_MATCH).astype(np.float64)


def build_blocks(rows: DataFrame, pivots: int = PIVOTS, block: int = BLOCK, seed: int = SEED) -> Blocks:
    """Blocks of rows (id, v), a written table; where there is a column cell, blocks are cut from equal cells instead of rings."""
    small_batches(rows.sparkSession)  # blocks are wide rows
    n = rows.count()
    drawn = bottom_k(rows, pivots, "id", seed).select("v").toPandas()["v"]
    centres = unit(np.array([np.asarray(v, np.float64) for v in drawn]).reshape(-1, EL_MATCH))

    def place(batches):
        for batch in batches:
            theta = angles(matrix(batch.column(1), EL_MATCH), centres)
            ball = theta.argmin(1) if len(theta) else np.zeros(0, np.int64)
            ring = (theta[np.arange(len(ball)), ball] / RING).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ball * 64 + ring)], ["id", "v", "cell"])

    size = max(block, -(-n // MOST_BLOCKS))
    placed = rows.select("id", "v", F.col("cell").cast("bigint")) if "cell" in rows.columns else rows.select("id", "v").mapInArrow(place, "id bigint, v array<bigint>, cell bigint")
    cuts = placed.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("cuts"))  # at most 16 rings a pivot, or the clusters
    dealt = placed.join(F.broadcast(cuts), "cell").select((F.col("cell") * (1 << 32) + F.pmod(F.xxhash64("id"), "cuts")).alias("block"), "id", "v")

    def row(key: tuple, t: pa.Table) -> pa.Table:
        x = matrix(t["v"], EL_MATCH)
        theta, centre = angles(x, centres), unit(unit(x).mean(0, keepdims=True))
        ends = {"centre": centre[0], "low": theta.min(0), "high": theta.max(0)}
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64())} | pack(t["id"].to_numpy(), x) | {"radius": pa.array([float(angles(x, centre).max())])} | {k: pa.array([e.tolist()], pa.list_(pa.float64())) for k, e in ends.items()})

    table = written(dealt.groupBy("block").applyInArrow(row, "block bigint, ids binary, vectors binary, radius double, centre array<double>, low array<double>, high array<double>"))
    known = table.drop("ids", "vectors").toPandas()  # MOST_BLOCKS rows, and one a cell
    stacked = lambda c, width: np.array(known[c].tolist(), np.float64).reshape(len(known), width)
    bounds = Bounds(centres, known["block"].to_numpy(np.int64), stacked("centre", EL_MATCH), known["radius"].to_numpy(np.float64), stacked("low", len(centres)), stacked("high", len(centres)))
    return Blocks(table.select("block", "ids", "vectors"), bounds)


def _route(blocks: Bounds, limit: float, later: bool):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids, x = part.column(0).to_numpy(), matrix(part.column(1), EL_MATCH)
                if not len(ids) or not len(blocks.block):
                    continue
                q, b = blocks.reached(x, limit)
                if later:
                    own = part.column(2).to_numpy()
                    q, b = q[blocks.block[b] >= own[q]], b[blocks.block[b] >= own[q]]
                order = np.argsort(b, kind="stable")
                q, b = q[order], b[order]
                starts = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else []
                for s, e in zip(starts, [*starts[1:], len(b)]):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([int(blocks.block[b[s]])])} | pack(ids[q[s:e]], x[q[s:e]]))

    return run


def meet(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, y: np.ndarray, tau: float, head: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(member, query, cosine) above the threshold, and how many pairs were multiplied in full."""
    squares, asked_squares = (x * x).sum(1), (y * y).sum(1)
    first = np.argsort(-squares.dot(x * x / squares[:, None]), kind="stable")[:head] if len(x) else np.arange(head)
    u, w = x / np.sqrt(squares)[:, None], y / np.sqrt(asked_squares)[:, None]
    rest = lambda z: np.sqrt(np.maximum(1 - (z[:, first] ** 2).sum(1), 0))
    bound = u[:, first] @ w[:, first].T + rest(u)[:, None] * rest(w)
    row, col = np.nonzero(bound > tau + EPS - SLACK)
    cos = np.zeros(len(row))
    for a in range(0, len(row), 1 << 16):
        r, c = row[a : a + (1 << 16)], col[a : a + (1 << 16)]
        cos[a : a + (1 << 16)] = np.einsum("ij,ij->i", x[r], y[c]) / (np.sqrt(squares[r]) * np.sqrt(asked_squares[c]))
    hit = cos - tau > EPS
    return row[hit], col[hit], cos[hit], len(row)


def meetings(met: DataFrame, tau: float, least: bool = False, once: bool = False) -> DataFrame:
    """(block, query_id, id, cos) of all meetings (block, ids, vectors, asked, wanted). once: queries are rows of the list, so that a query in its own block takes part as the lesser id of a pair only."""
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, x = _unpack(batch.column(1)[k], batch.column(2)[k])
                asked, y = _unpack(batch.column(3)[k], batch.column(4)[k])
                row, col, cos, _ = meet(ids, x, asked, y, tau)
                if once:
                    good = (asked[col] <= ids[row]) | ~np.isin(asked, ids)[col]
                    row, col, cos = row[good], col[good], cos[good]
                if least and len(row):
                    order = np.lexsort((ids[row], col))
                    order = order[np.append(True, col[order][1:] != col[order][:-1])]
                    row, col, cos = row[order], col[order], cos[order]
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(row), batch.column(0)[k].as_py(), np.int64)), "query_id": pa.array(asked[col]), "id": pa.array(ids[row]), "cos": pa.array(cos)})

    return met.mapInArrow(run, "block bigint, query_id bigint, id bigint, cos double")


def routed(queries: DataFrame, blocks: Blocks, tau: float, later: bool = False) -> DataFrame:
    """(block, ids, vectors, asked, wanted): every block with the packed queries (id, v) that may have hits in it.

    later: queries are rows of the blocks themselves (id, v, block), and go to their own and later blocks only, so a pair of blocks meets once.
    """
    limit = float(np.arccos(min(tau, 1.0))) + SLACK
    sent = written(queries.mapInArrow(_route(blocks.bounds, limit, later), "block bigint, ids binary, vectors binary").toDF("block", "asked", "wanted"))
    load = F.broadcast(sent.groupBy("block").agg(F.ceil(F.count("*") / MEETS).alias("copies")))  # no more rows than blocks
    asked = sent.join(load, "block").withColumn("copy", F.pmod(F.xxhash64("asked"), "copies"))
    copies = blocks.table.join(load, "block").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1))).drop("copies")
    return copies.join(asked.drop("copies"), ["block", "copy"]).select("block", "ids", "vectors", "asked", "wanted")


def least_hits(queries: DataFrame, blocks: Blocks, tau: float = TAU) -> DataFrame:
    """(query_id, id, cos) of queries (id, v): of each query and packed row of queries the hit of the least id in a block."""
    return meetings(routed(queries, blocks, tau), tau, least=True)


def work(met: DataFrame, tau: float = TAU) -> DataFrame:
    """(block, met, multiplied): pairs that meet in each block, and those that are multiplied in full."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, x = _unpack(batch.column(1)[k], batch.column(2)[k])
                asked, y = _unpack(batch.column(3)[k], batch.column(4)[k])
                yield pa.RecordBatch.from_pydict({"block": batch.column(0).slice(k, 1), "met": pa.array([len(x) * len(y)]), "multiplied": pa.array([meet(ids, x, asked, y, tau)[3]])})

    return met.mapInArrow(run, "block bigint, met bigint, multiplied bigint").groupBy("block").agg(F.sum("met").alias("met"), F.sum("multiplied").alias("multiplied"))


def _copies(rows: DataFrame, id_col: str, base: DataFrame, name: str) -> DataFrame:
    """(rep, name): every id with the one that stands for its signature."""
    return rows.select(F.col(id_col).cast("bigint").alias(name), F.slice("sig", 1, EL_MATCH).alias("v")).join(base.withColumnRenamed("id", f"{name}_rep"), "v").drop("v")


def join(queries: DataFrame, database: DataFrame, tau: float = TAU, least: bool = False, block: int = BLOCK) -> DataFrame:
    """(query_id, id, cos) of all pairs above the threshold; inputs have (query_id | id, sig, n2_50).

    least: of each query only the hits of the least id in each block, one at least for a query that has any, and the least of all among them.
    """
    check_tau(tau)
    base = written(distinct(database, "id"))
    asked = written(distinct(queries, "query_id"))
    blocks = build_blocks(base, block=block)
    hits = least_hits(asked, blocks, tau) if least else meetings(routed(asked, blocks, tau), tau)
    out = hits.withColumnRenamed("query_id", "query_id_rep").join(_copies(queries, "query_id", asked, "query_id"), "query_id_rep")
    if not least:
        out = out.withColumnRenamed("id", "id_rep").join(_copies(database, "id", base, "id"), "id_rep")
    return out.select("query_id", "id", "cos")


def self_join(rows: DataFrame, tau: float = TAU, block: int = BLOCK) -> DataFrame:
    """(id1, id2, cos) of all pairs id1 < id2 above the threshold, each found once; rows have (id, sig, n2_50)."""
    check_tau(tau)
    base = written(distinct(rows, "id"))
    blocks = build_blocks(base, block=block)

    def own(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, x = _unpack(batch.column(1)[k], batch.column(2)[k])
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * EL_MATCH), pa.array(x.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "v": values, "block": pa.array(np.full(len(ids), batch.column(0)[k].as_py()))})

    members = blocks.table.mapInArrow(own, "id bigint, v array<bigint>, block bigint")
    hits = meetings(routed(members, blocks, tau, later=True), tau, once=True).withColumnsRenamed({"query_id": "a_rep", "id": "b_rep"})
    out = hits.join(_copies(rows, "id", base, "a"), "a_rep").join(_copies(rows, "id", base, "b"), "b_rep")
    paired = out.where((F.col("a_rep") != F.col("b_rep")) | (F.col("a") < F.col("b")))
    return paired.select(F.least("a", "b").alias("id1"), F.greatest("a", "b").alias("id2"), "cos")
