"""Joins, searches and rounds that leave work out by bounds must give what doing all of it gives."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from namesieve.functions import minhash
from namesieve.operators import index, kmeans, metrics, search, threshold
from namesieve.params import SEED, seed_positions
from namesieve.plans import protocol
from namesieve.sources import tables


def some_names(n, seed):
    """Random names, families of near ones, and many copies."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    out = [f"{word()} {word()} {word()}" for _ in range(n // 3)]
    stem = [f"{word()} {word()} {word()} {word()}" for _ in range(6)]
    while len(out) < n - 40:
        name = rnd.choice(stem if rnd.random() < 0.6 else out)
        at = rnd.randrange(len(name))
        out.append(name[:at] + rnd.choice("aeiou") + name[at + 1 :])
    return out + ["one name many times"] * 35 + ["", "a", "Ünïcode", "12 34", "zz"]


def encoded(spark, names, id_col="id", first=0):
    return minhash.batch_encode(spark.createDataFrame([(first + 3 * i, n) for i, n in enumerate(names)], f"{id_col} bigint, name string").repartition(3)).drop("name")


def cosines(left, right):
    x, y = (minhash.signatures_of(pa.array([r.clean for r in rows]))[:, :50].astype(float) for rows in (left, right))
    return x @ y.T / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))


@pytest.mark.parametrize(("tau", "block"), [(0.9, 2048), (0.9, 16), (0.7, 64), (0.999999, 64)])
def test_join_equals_all_products(spark, tau, block):
    base, asked = encoded(spark, some_names(400, 1)), encoded(spark, some_names(120, 2)[:40] + some_names(400, 1)[::4], "query_id", -50)
    b, q = base.collect(), asked.collect()
    cos = cosines(q, b)
    want = {(q[i].query_id, b[j].id) for i, j in zip(*np.nonzero(cos - tau > 1e-6))}
    got = threshold.join(asked, base, tau, block=block).collect()
    assert len(got) == len(want) and {(r.query_id, r.id) for r in got} == want
    at, bt = {r.query_id: i for i, r in enumerate(q)}, {r.id: j for j, r in enumerate(b)}
    assert all(r.cos == pytest.approx(cos[at[r.query_id], bt[r.id]], abs=1e-12) for r in got)
    first = {}
    for i, j in want:
        first[i] = min(first.get(i, j), j)
    least = threshold.join(asked, base, tau, least=True, block=block).groupBy("query_id").agg(F.min("id").alias("id")).collect()
    assert {r.query_id: r.id for r in least} == first


@pytest.mark.parametrize("block", [2048, 16])
def test_self_join_finds_each_pair_once(spark, block):
    rows = encoded(spark, some_names(300, 3))
    r = rows.collect()
    near = np.argwhere(cosines(r, r) - 0.9 > 1e-6)
    want = sorted({(min(r[i].id, r[j].id), max(r[i].id, r[j].id)) for i, j in near if i != j})
    assert sorted((x.id1, x.id2) for x in threshold.self_join(rows, 0.9, block).collect()) == want


def test_bounds_leave_most_pairs_out(spark):
    rows = encoded(spark, some_names(900, 4))
    base = tables.written(threshold.distinct(rows, "id"))
    blocks = threshold.build_blocks(base, block=32)
    sums = threshold.work(threshold.routed(base, blocks, 0.9)).agg(F.sum("met").alias("met"), F.sum("multiplied").alias("multiplied")).first()
    every = 900 * 900
    assert 0 < sums.multiplied < 0.1 * every and sums.met < 0.8 * every
    value = np.array(rows.select(F.slice("sig", 1, 50).alias("v")).first().v, float)[None]
    theta = threshold.angles(value, blocks.bounds.pivots)
    assert ((theta >= blocks.bounds.low - 4) & (theta <= blocks.bounds.high + 4)).all()


def test_empty_sides_give_no_hits(spark):
    rows, none = encoded(spark, ["a name", "b name"]), encoded(spark, ["x"]).limit(0)
    assert threshold.self_join(none).count() == 0
    assert threshold.join(rows.withColumnRenamed("id", "query_id"), none).count() == 0
    assert threshold.join(none.withColumnRenamed("id", "query_id"), rows).count() == 0
    with pytest.raises(ValueError):
        threshold.join(rows.withColumnRenamed("id", "query_id"), rows, 0)


def test_screening_all_clusters_misses_nothing(spark):
    names = spark.createDataFrame(list(enumerate(some_names(300, 5))), "id bigint, name string")
    asked = spark.createDataFrame([(-i, n) for i, n in enumerate(some_names(90, 6)[:30] + some_names(300, 5)[::5])], "query_id bigint, name string")
    built = index.build_index(names, 12)
    got = {r.query_id: (r.catch, r.matched_id) for r in search.screen_all(asked, built).collect()}
    hits = search.hits_linear(minhash.batch_encode(asked), minhash.batch_encode(names)).groupBy("query_id").agg(F.min("id").alias("id")).collect()
    want = {r.query_id: (True, r.id) for r in hits}
    assert got == {r.query_id: want.get(r.query_id, (False, None)) for r in asked.collect()}
    assert sum(r.catch for r in search.screen(asked, built).collect()) <= len(want)


def test_names_with_gaps_and_null_names(spark):
    rows = [(10 * i + (i > 20), None if i % 7 == 3 else n) for i, n in enumerate(some_names(120, 8))]
    names = spark.createDataFrame(rows, "id bigint, name string")
    run = protocol.run_queries(names.where("name is not null").select(F.col("id").alias("query_id"), "name"), names)
    assert run.index.n == sum(n is not None for _, n in rows) and run.result.where("not catch").count() == 0


def test_bottom_k_is_the_same_however_rows_are_dealt(spark):
    rows = spark.range(5000).select((F.col("id") * 17 - 9000).alias("id"))
    some = [[r.id for r in tables.bottom_k(rows.repartition(p), 40, "id", 7).collect()] for p in (1, 6)]
    assert some[0] == some[1] and len(set(some[0])) == 40
    assert some[0] != [r.id for r in tables.bottom_k(rows, 40, "id", 8).collect()]
    assert tables.bottom_k(rows.limit(3), 40, "id", 7).count() == 3
    share = np.mean([x < 5000 * 17 / 2 - 9000 for s in range(25) for x in [r.id for r in tables.bottom_k(rows, 40, "id", s).collect()]])
    assert 0.42 < share < 0.58


def test_seeds_are_positions_where_ids_are_positions(spark):
    rows = spark.range(60).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("z"))
    assert kmeans.seeds(rows, 60, 5)[:, 0].tolist() == seed_positions(60, 5, SEED)
    gaps = rows.withColumn("id", F.col("id") * 2)
    assert len({tuple(x) for x in kmeans.seeds(gaps, 60, 5).tolist()}) == 5
    assert (kmeans.seeds(gaps, 60, 5) == kmeans.seeds(gaps.repartition(4), 60, 5)).all()


def test_rounds_with_bounds_equal_full_rounds(spark):
    rnd = np.random.RandomState(3)
    centres = rnd.normal(size=(12, 20))
    x = np.concatenate([c + 0.9 * rnd.normal(size=(150, 20)) for c in centres])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, z array<double>").repartition(4)
    shares = []
    got = kmeans.fit(points, 16, rounds=12, shares=shares)
    want = kmeans._unit(np.array([x[i] for i in seed_positions(len(x), 16, SEED)]))
    for _ in range(len(shares)):
        before = want
        best, _ = kmeans.nearest(x, want)
        want = np.array([kmeans._unit(x[best == c].mean(0)) if (best == c).any() else None for c in range(16)])
    assert np.allclose(got, want, atol=1e-9) and before.shape == want.shape
    assert len(shares) > 4 and min(shares[2:]) < 0.5 and np.mean(shares) < 1


def test_renewed_clusters_are_the_nearest_ones(monkeypatch):
    monkeypatch.setattr(kmeans, "_BLOCK", 7)
    rnd = np.random.RandomState(4)
    x, c = rnd.normal(size=(300, 6)), rnd.normal(size=(40, 6))
    c[5] = c[17]  # equal ones: the lower number
    x[:5] = c[17]
    groups = kmeans.groups_of(c)
    assert len(set(groups.tolist())) == kmeans.GROUPS
    own, _ = kmeans.nearest(x, c)
    sims = kmeans._unit(x) @ kmeans._unit(c).T
    sims[np.arange(300), own] = -1
    bounds = np.stack([kmeans._angle(sims[:, groups == g].max(1)) for g in range(kmeans.GROUPS)], 1)
    for scale in (0.0, 0.02, 0.5):
        new = c + scale * rnd.normal(size=c.shape) * (np.arange(40) % 3 == 0)[:, None]
        step = kmeans._angle((kmeans._unit(c) * kmeans._unit(new)).sum(1)) + 1e-5
        moved = np.array([step[groups == g].max() for g in range(kmeans.GROUPS)])
        best, top, products = kmeans._renewed(x, own, bounds, new, groups, moved)
        want = kmeans.nearest(x, new)
        assert (best == want[0]).all() and np.allclose(top, want[1]) and (products < 300 * 20 or scale == 0.5)


@pytest.mark.parametrize("few", [10_000, 10])
def test_median_is_exact(spark, few, monkeypatch):
    monkeypatch.setattr(metrics, "_FEW", few)
    rnd = random.Random(1)
    lists = [[1.0], [1.0, 2.0], [rnd.gauss(0, 1) for _ in range(3001)], [rnd.gauss(0, 1) * 10 ** rnd.randint(-200, 200) for _ in range(3000)], [5.0] * 1500 + [rnd.random() * 9 for _ in range(1501)], [0.0] * 50 + [1.0] * 50, [float(i % 3) for i in range(2000)]]
    for values in lists:
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double").repartition(3)
        assert metrics.median(df, "x") == pytest.approx(float(np.median(values)), rel=1e-15)
        ordered = sorted(values)
        for rank in {0, len(values) // 3, len(values) - 1}:
            assert metrics.ranked_value(df, "x", rank) == ordered[rank]
    assert metrics.median(spark.createDataFrame([(None,)], "x double"), "x") is None
    with pytest.raises(ValueError):
        metrics.ranked_value(df, "x", 2000)


def test_a_loaded_index_is_joined_where_it_lies(spark, tmp_path):
    names = spark.createDataFrame(list(enumerate(some_names(300, 5))), "id bigint, name string")
    asked = spark.createDataFrame([(-i, n) for i, n in enumerate(some_names(300, 5)[::3] + ["nobody at all"])], "query_id bigint, name string")
    built, path = index.build_index(names, 6), str(tmp_path / "ix")
    assert index.save_index(built, path, buckets=4) == 1
    loaded = index.load_index(spark, path)
    want = sorted(map(str, search.screen(asked, built).collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.screen(asked, loaded)
        assert sorted(map(str, found.collect())) == want
        hits = search.hits_packed(search.probe(asked, loaded), loaded.blocks)
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.splitlines()
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin [block" in x)
    scan = next(i for i, x in enumerate(lines) if i > join and "FileScan" in x)
    assert "Bucketed: true" in lines[scan] and "vectors" in lines[scan] and not any("Exchange" in x for x in lines[join:scan])
    for probes in (1, 3):
        assert sorted(map(str, search.screen(asked, loaded, nprobe=probes).collect())) == sorted(map(str, search.screen(asked, built, nprobe=probes).collect()))


def test_versions_are_whole_or_refused(spark, tmp_path):
    names = spark.createDataFrame(list(enumerate(some_names(80, 5))), "id bigint, name string")
    path = str(tmp_path / "ix")
    with pytest.raises(FileNotFoundError):
        index.load_index(spark, path)
    first, second = index.build_index(names, 3), index.build_index(names.where("id < 40"), 2)
    assert (index.save_index(first, path, 2), index.save_index(second, path, 2)) == (1, 2)
    assert index.load_index(spark, path).n == 40 and index.load_index(spark, path, 1).n == 80
    (tmp_path / "ix" / "v3" / "members").mkdir(parents=True)  # a writer that failed
    (tmp_path / "ix" / "v3" / "members" / "part-0.parquet").write_bytes(b"x")
    assert index.versions(spark, path) == [1, 2] and index.load_index(spark, path).n == 40
    with pytest.raises(FileNotFoundError):
        index.load_index(spark, path, 3)
    victim = next((tmp_path / "ix" / "v2" / "blocks").glob("part-*.parquet"))
    victim.write_bytes(victim.read_bytes()[:-5])
    with pytest.raises(ValueError, match="torn"):
        index.load_index(spark, path)
    assert index.load_index(spark, path, 1).n == 80
    assert index.save_index(second, path, 2) == 3 and index.load_index(spark, path).n == 40
