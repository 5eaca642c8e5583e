"""Cosine K-Means: a Lloyd loop whose state is k centroids on the driver.

A round is one scan: each batch multiplies its rows with the centroids, and
sends a sum and a count for each cluster it met, and its farthest row.  Sums are
added by cluster and dimension with partial aggregates, so a hot cluster costs
each task one row a dimension.

Few rows change their cluster in later rounds.  A written table keeps each
row's cluster, and of each of GROUPS groups of centroids the angle to the nearest
one (its own left out).  Angles are a metric: while a row's angle to its own
centroid is less than a group's bound less the furthest that a centroid of the
group has moved since, no centroid of that group can be nearer, and none is
multiplied.  The table is written anew when it has lost its force.  Centroids are
those of multiplying everything.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.minhash import matrix
from ..params import KMEANS_ROUNDS, KMEANS_SHIFT, NEAR_ZERO, PARITY_ROWS, SEED, seed_positions
from ..sources.tables import bottom_k, written

#: Centroids are held by the driver and every task: 640 MB at this many, which the default choice reaches at 160 billion names.
MOST_CLUSTERS = 400_000
#: Centroids and rows of one product.
_BLOCK, _ROWS = 4096, 1024
#: Radians by which bounds are loosened: far above what rounding cosines to 12 decimals can make of an angle.
_LOOSE = 1e-5
GROUPS = 12


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster of greatest cosine for each row, the lowest of equal ones, and that cosine."""
    best, top = np.zeros(len(x), np.int64), np.full(len(x), -np.inf)
    for r in range(0, len(x), _ROWS):  # a bounded product at a time
        rows, found, most = _unit(x[r : r + _ROWS]), best[r : r + _ROWS], top[r : r + _ROWS]
        for a in range(0, len(centroids), _BLOCK):
            sims = _cosines(rows, centroids[a : a + _BLOCK])
            at = sims.argmax(1)
            value = sims[np.arange(len(rows)), at]
            better = value > most
            found[better], most[better] = at[better] + a, value[better]
    return best, top


def _cosines(unit_rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.round(unit_rows @ _unit(centroids).T, 12)  # else rounding errors choose among equal centroids


def groups_of(centroids: np.ndarray) -> np.ndarray:
    """A group for each centroid: GROUPS of them at most, around centroids far from each other."""
    unit, chosen = _unit(centroids), [0]
    near = unit @ unit[0]
    while len(chosen) < min(GROUPS, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return (unit @ unit[chosen].T).argmax(1)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _renewed(x: np.ndarray, own: np.ndarray, bounds: np.ndarray, centroids: np.ndarray, groups: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(cluster, cosine) of each row as nearest gives them, and the number of products; bounds: angles to each group's nearest centroid but their own, before these moved."""
    x, best = _unit(x), own.copy()
    top = np.round(np.einsum("ij,ij->i", x, _unit(centroids[own])), 12)
    loose = _angle(top)[:, None] + _LOOSE >= bounds - moved
    products = len(x)
    for g in range(bounds.shape[1]):
        every, members = np.flatnonzero(loose[:, g]), np.flatnonzero(groups == g)
        products += len(every) * len(members)
        for r, a in itertools.product(range(0, len(every), _ROWS), range(0, len(members), _BLOCK)):
            rows, some = every[r : r + _ROWS], members[a : a + _BLOCK]
            sims = _cosines(x[rows], centroids[some])
            at = sims.argmax(1)
            value, found = sims[np.arange(len(rows)), at], some[at]
            better = (value > top[rows]) | (value == top[rows]) & (found < best[rows])
            best[rows[better]], top[rows[better]] = found[better], value[better]
    return best, top, products


def _round(points: DataFrame, centroids: np.ndarray, vector: str, id_col: str, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, int]:
    """The next centroids and the number of products; state: points have own and bounds, for these groups, whose centroids have not moved further since."""
    k, width = centroids.shape
    kept = [] if state is None else ["own", "bounds"]

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), width)
            if not len(x):
                continue
            if state is None:
                (best, sims), products = nearest(x, centroids), len(x) * k
            else:
                best, sims, products = _renewed(x, batch.column(2).to_numpy().astype(np.int64), matrix(batch.column(3), len(state[1])), centroids, *state)
            order = np.argsort(best, kind="stable")
            some, starts = np.unique(best[order], return_index=True)
            sums = np.add.reduceat(x[order], starts, axis=0)
            ids = batch.column(0).to_numpy()
            far = np.lexsort((ids, sims))[0]
            yield pa.RecordBatch.from_pydict({
                "cluster_id": pa.array(np.append(some, (-1, -2)).astype(np.int32)),
                "n": pa.array(np.append(np.bincount(best, minlength=k)[some], (1, products))),
                "sim": pa.array(np.append(np.zeros(len(some)), (sims[far], 0.0))),
                "id": pa.array(np.append(np.full(len(some), ids[0]), (ids[far], 0))),
                "v": pa.array([*sums, x[far], x[far]], pa.list_(pa.float64())),
            })

    parts = points.select(id_col, vector, *kept).mapInArrow(run, "cluster_id int, n bigint, sim double, id bigint, v array<double>")
    sums = parts.where("cluster_id <> -1").select("cluster_id", "n", F.posexplode("v").alias("dim", "x")).groupBy("cluster_id", "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = sums.groupBy("cluster_id").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).collect()  # k rows
    found = {r.cluster_id: np.array([x.x for x in r.v]) / r.n for r in rows}
    products = next((r.n for r in rows if r.cluster_id == -2), 0)
    found.pop(-2, None)
    if len(found) < k:  # the farthest row, which empty clusters take
        far = parts.where("cluster_id = -1").agg(F.min_by("v", F.struct("sim", "id")).alias("v")).first()
        found[-1] = np.array(far.v)
    out = np.empty_like(centroids)
    for c in range(k):
        v = found[c] if c in found else found[-1]
        norm = np.linalg.norm(v)
        out[c] = centroids[c] if norm < NEAR_ZERO else v / norm
    return out, products


def lloyd_round(points: DataFrame, centroids: np.ndarray, vector: str = "z", id_col: str = "id") -> np.ndarray:
    """The next centroids; every cluster that is left empty takes the farthest row, near-zero means keep the old centroid."""
    return _round(points, centroids, vector, id_col)[0]


def _stretches(batches):
    """The batches in stretches of _ROWS rows at most."""
    for batch in batches:
        for r in range(0, batch.num_rows, _ROWS):
            yield batch.slice(r, _ROWS)


def bounded(points: DataFrame, centroids: np.ndarray, groups: np.ndarray, vector: str = "z", id_col: str = "id") -> DataFrame:
    """A written table of the points with own, their cluster, and bounds, the angle to the nearest centroid of each group but their own."""
    width, many = centroids.shape[1], int(groups.max()) + 1

    def run(batches):
        for batch in _stretches(batches):
            x = _unit(matrix(batch.column(1), width))
            best, _ = nearest(x, centroids)
            bounds = np.full((len(x), many), np.pi)
            for a in range(0, len(centroids), _BLOCK):
                sims = _cosines(x, centroids[a : a + _BLOCK])
                mine = np.flatnonzero((best >= a) & (best < a + sims.shape[1]))
                sims[mine, best[mine] - a] = -1.0
                for g in np.unique(groups[a : a + _BLOCK]):
                    bounds[:, g] = np.minimum(bounds[:, g], _angle(sims[:, groups[a : a + _BLOCK] == g].max(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * many), pa.array(bounds.ravel()))
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), vector: batch.column(1), "own": pa.array(best.astype(np.int32)), "bounds": lists})

    base = points.select(F.col(id_col).cast("bigint"), vector)
    return written(base.mapInArrow(run, f"{id_col} bigint, {vector} array<double>, own int, bounds array<double>"))


def seeds(points: DataFrame, n: int, k: int, seed: int = SEED, vector: str = "z", id_col: str = "id") -> np.ndarray:
    """The k rows that seed the clusters: drawn positions where ids are the positions 0..n-1 and n is at most PARITY_ROWS; else those of least keyed hash."""
    if n <= PARITY_ROWS:
        where = seed_positions(n, k, seed)
        chosen = points.sparkSession.createDataFrame(pa.table({"_seed": pa.array(where, pa.int64())}))
        found = points.join(F.broadcast(chosen), F.col(id_col) == F.col("_seed")).select(id_col, vector).collect()  # k rows
        ends = points.agg(F.min(id_col), F.max(id_col)).first()
        rows = {r[0]: r[1] for r in found}
        if len(rows) == len(found) == k and tuple(ends) == (0, n - 1):
            return np.array([rows[i] for i in where])
    return np.array([r[0] for r in bottom_k(points, k, id_col, seed).select(vector).collect()])


def fit(points: DataFrame, k: int, seed: int = SEED, rounds: int = KMEANS_ROUNDS, vector: str = "z", id_col: str = "id", shares: list[float] | None = None) -> np.ndarray:
    """Centroids (k, width); ids may be any numbers, with gaps; shares gets the share of all products that each round made."""
    n = points.count()
    if not n:
        raise ValueError("there is nothing to cluster")
    if k <= 0:
        raise ValueError(f"cannot make {k} clusters")
    if min(k, n) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters: centroids are held by the driver and every task")
    centroids = _unit(seeds(points, n, min(k, n), seed, vector, id_col))
    k, table, groups, moved, share = len(centroids), points, None, None, 1.0
    for number in range(rounds):
        extra = 0
        if number and share > 0.5:
            groups = groups_of(centroids)
            table, moved, extra = bounded(points, centroids, groups, vector, id_col), np.zeros(int(groups.max()) + 1), n * k
        before = centroids
        centroids, products = _round(table, centroids, vector, id_col, None if groups is None else (groups, moved))
        share = products / (n * k)
        if shares is not None:
            shares.append(share + extra / (n * k))
        if groups is not None:
            step = _angle(np.einsum("ij,ij->i", _unit(before), _unit(centroids))) + _LOOSE
            moved = moved + np.array([step[groups == g].max(initial=0.0) for g in range(len(moved))])
        if np.linalg.norm(centroids - before, axis=1).max() < KMEANS_SHIFT:
            break
    return centroids


def assign(points: DataFrame, centroids: np.ndarray, vector: str = "z", nprobe: int = 1) -> DataFrame:
    """All columns of points, cluster_id and score of each of the nprobe nearest clusters (score: dot with the unit centroid)."""
    kept = points.columns
    width = centroids.shape[1]
    unit = _unit(centroids)

    def run(batches):
        for batch in _stretches(batches):
            x = matrix(batch.column(vector), width)
            top = nearest(x, centroids)[0][:, None] if nprobe == 1 else np.argsort(-np.round(_unit(x) @ unit.T, 12), axis=1, kind="stable")[:, :nprobe]
            row = np.repeat(np.arange(len(x)), top.shape[1])
            scores = np.einsum("ij,ij->i", x[row], unit[top.ravel()])
            take = pa.array(row)
            yield pa.RecordBatch.from_pydict({c: batch.column(c).take(take) for c in kept} | {"cluster_id": pa.array(top.ravel().astype(np.int32)), "score": pa.array(scores)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"{kinds}, cluster_id int, score double")
