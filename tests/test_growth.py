"""What a task holds does not grow with repeated rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesieve.functions import minhash, text
from namesieve.operators import kmeans, scaler, search, threshold
from namesieve.plans import queries

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_equal_names_share_one_prefix_and_null_names_have_none(spark, tmp_path):
    names = [(i, ["large ring", "Large  ring!", "li", "", None][i % 5]) for i in range(50)]
    spark.createDataFrame(names, "p_partkey bigint, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    df = queries.minhash_prefix(spark, str(tmp_path))
    got = {r.id: r.prefix for r in df.collect()}
    want = {r.id: " ".join(map(str, r.sig[:50])) for r in minhash.batch_encode(spark.createDataFrame(names, "id bigint, name string")).collect()}
    assert got == want and len(got) == 40
    assert "Aggregate" in plan(df) and "Join" in plan(df)


def test_shingles_are_hashed_once_for_all_permutations(spark):
    clean = spark.createDataFrame([("large ring",)], "c string").where("c <> ''")
    found = plan(clean.select(minhash.signature(F.col("c"), 50).alias("s")))
    assert found.index("transform(array(") < found.index("sha2")  # bound before the permutations


def test_distinct_names_are_standardised_without_sorting_vectors(spark):
    df = queries.standardise(spark, SF)
    assert "first(z" not in plan(df)
    assert df.count() == 200 * queries._parts(spark, SF).select(text.clean_name(F.col("name"))).distinct().count()


def test_weights_stand_for_repeated_rows(spark):
    names = [(i, f"{'abcdefg'[i % 7]} ring {'xyz'[i % 3] * 3}") for i in range(60)]
    rows = minhash.batch_encode(spark.createDataFrame(names, "id bigint, name string"))
    each = queries._weighted(spark.createDataFrame(names, "id bigint, name string"))
    assert each.count() == 21 and each.agg(F.sum("n")).first()[0] == 60
    for a, b in zip(scaler.collected(scaler.fit_scaler(rows)), scaler.collected(scaler.fit_scaler(each, weight="n")), strict=True):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)


def test_selectors_pick_their_cluster_without_an_aggregate_over_queries(spark):
    members = spark.createDataFrame([(c, j, [float(100 * c + 10 * j + i) for i in range(3)]) for c, j in ((0, 0), (0, 1), (1, 0), (2, 0), (9, 5))], "cluster_id int, column_index int, sig50 array<double>")
    asked = {1: [1.0, 0.0, 0.0], 2: [0.0, 0.5, 2.0], 3: [0.0, 0.0, 0.0]}
    out = search.selector_product(spark.createDataFrame(list(asked.items()), "query_id bigint, selector array<double>"), members)
    got = {(r.query_id, r.column_index, r.dim): r.val for r in out.collect()}
    value = lambda c, j, i: 100 * c + 10 * j + i
    want = {(q, j, i): sum(s[c] * value(c, j, i) for c in cs) for q, s in asked.items() for j, cs in ((0, (0, 1, 2)), (1, (0,))) for i in range(3)}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    assert "query_id" not in "".join(line for line in plan(out).splitlines() if "Aggregate" in line)


def test_products_of_k_means_are_bounded_in_rows_and_centroids(monkeypatch):
    sizes, cosines = [], kmeans._cosines
    monkeypatch.setattr(kmeans, "_cosines", lambda x, c: sizes.append(len(x) * len(c)) or cosines(x, c))
    rnd = np.random.RandomState(1)
    x, c = rnd.randn(3000, 8), rnd.randn(50, 8)
    best, top = kmeans.nearest(x, c)
    groups = kmeans.groups_of(c)
    again = kmeans._renewed(x, np.zeros(3000, np.int64), np.zeros((3000, groups.max() + 1)), c, groups, np.zeros(groups.max() + 1))
    sims = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (c / np.linalg.norm(c, axis=1, keepdims=True)).T, 12)
    assert (best == sims.argmax(1)).all() and (again[0] == best).all() and np.allclose(top, sims.max(1)) and max(sizes) <= 1024 * 50


def test_reached_blocks_are_those_of_one_product(monkeypatch):
    rnd = np.random.RandomState(2)
    centre, pivots, x = (threshold.unit(rnd.rand(n, 50)) for n in (40, 5, 100))
    bounds = threshold.Bounds(pivots, np.arange(40), centre, rnd.rand(40), np.zeros((40, 5)), np.full((40, 5), 4.0))
    want = bounds.reached(x, 0.1)
    seen, angles = [], threshold.angles
    monkeypatch.setattr(threshold, "angles", lambda z, c: seen.append(len(z) * len(c)) or angles(z, c))
    monkeypatch.setattr(threshold, "REACH", 280)
    got = bounds.reached(x, 0.1)
    assert all((a == b).all() for a, b in zip(got, want)) and len(got[0]) > 100 and sorted(seen)[-2] <= 280


@pytest.mark.parametrize("least", [True, False])
def test_blocks_of_queries_are_multiplied_in_stretches(spark, monkeypatch, least):
    monkeypatch.setattr(search, "STRETCH", 3)
    names = spark.createDataFrame([(i, f"{'abcd'[i % 4] * 3} long ring") for i in range(40)], "id bigint, name string")
    e = minhash.batch_encode(names).select("id", F.slice("sig", 1, 50).alias("v"), "n2_50")
    members = e.select(F.lit(3).alias("cluster_id"), F.col("id").alias("column_index"), F.col("v").alias("sig50"), "n2_50")
    asked = e.select(F.lit(3).alias("cluster_id"), F.col("id").alias("query_id"), F.col("v").alias("q50"), F.col("n2_50").alias("q2"))
    got = {(r.query_id, r.column_index) for r in search.hits_clustered(asked, members, tau=0.999, least=least).collect()}
    assert got == {(q, c) for q in range(40) for c in ([q % 4] if least else range(q % 4, 40, 4))}


def test_wide_rows_go_to_python_in_small_batches(spark):
    queries.pruned_catch(spark, SF).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"
