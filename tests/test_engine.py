"""Engine behaviour: stated facts, golden values, properties, and independent NumPy versions."""

import hashlib
import json
import re
import threading
import unicodedata
import urllib.request

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from namesieve import cipher, cli, streaming
from namesieve.functions import minhash, text, vector
from namesieve.operators import index, kmeans, metrics, projection, scaler, search
from namesieve.params import Options, choose_k, hash_family, seed_positions
from namesieve.plans import benchmark, demo, protocol, rounds
from namesieve.sources import datasets, reports

NAMES = ["john smith", "mary jones", "timothy duane armstrong", "timothy duane aarmstrong", "nathan edward aaron", "joy gayle cooper", "harold grant abbott", "li", "", "O'Brien-Smith", "José Núñez", "ＦＵＬＬ width", "ﬁsher", "a b c\x1cd\x85e", "12345", "deborah elaine black", "donna west black", "james michael aaron", "harold grnt abbott", "mary  JONES"]


def py_clean(s):
    s = unicodedata.normalize("NFKC", s).lower().strip()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", "", s)).strip()


def py_signature(s):
    c = py_clean(s)
    grams = {c[i : i + 3] for i in range(len(c) - 2)} if len(c) >= 3 else {c or "<empty>"}
    h = np.array([int(hashlib.sha256(g.encode()).hexdigest(), 16) % 2**20 for g in grams], np.int64)
    a, b = hash_family()
    return ((h[:, None] * a + b) % 2**20).min(0)


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "id bigint, name string")


def test_choose_k():
    assert [choose_k(*x) for x in ((10, "sqrt"), (1, "sqrt"), (100, 50), (10, 50), (100, "50"), (100, "fixed:50"))] == [3, 1, 50, 10, 50, 50]
    with pytest.raises(NotImplementedError):
        choose_k(10, "paper")
    for bad in ("fixed:abc", "unknown"):
        with pytest.raises(ValueError):
            choose_k(10, bad)


def test_family_and_seeds():
    a, b = hash_family()
    assert a[:5].tolist() == [121959, 671156, 131933, 365839, 259179] and b[:5].tolist() == [769598, 50015, 772838, 122096, 631347]
    assert seed_positions(100, 10) == [83, 53, 70, 45, 44, 39, 22, 80, 10, 0]
    with pytest.raises(ValueError):
        hash_family(201)


def test_clean_and_signatures(names):
    rows = minhash.batch_encode(names).withColumn("spec", minhash.signature(F.col("clean"))).collect()
    for r in rows:
        assert r.clean == py_clean(r.name) and r.sig == r.spec == py_signature(r.name).tolist()
        assert r.n2_50 == sum(v * v for v in r.sig[:50]) and r.n2_200 == sum(v * v for v in r.sig)
    sig = {r.name: r.sig for r in rows}
    assert sig["john smith"][:6] == [47543, 38043, 75909, 24880, 142124, 176308] and sig[""][:3] == [962968, 294615, 596068]
    assert sig["mary jones"] == sig["mary  JONES"]


def test_nulls_and_empty_lists(spark):
    df = spark.createDataFrame([(0, None), (1, "x")], "id bigint, name string")
    assert minhash.batch_encode(df).count() == 1 and minhash.batch_encode(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        index.build_index(df.limit(0))
    with pytest.raises(ValueError):
        minhash.matrix(pa.array([[1.0], [1.0, 2.0]]), 1)


def test_sql_functions(spark):
    vector.register(spark)
    r = spark.sql("select clean_name(\"O'Brien-Smith\") c, minhash('john smith') m, minhash_cosine(minhash('john smith'), minhash('John  SMITH')) x").first()
    assert (r.c, r.m, round(r.x, 9)) == ("obriensmith", py_signature("john smith")[:50].tolist(), 1.0)
    odd = spark.createDataFrame([(n,) for n in [*NAMES, "a\u2003b\u00a0c", None]], "s string")
    odd.createOrReplaceTempView("odd_names")
    assert all(r.c == (None if r.s is None else py_clean(r.s)) for r in spark.sql("select s, clean_name(s) c from odd_names").collect())
    assert spark.sql("select minhash_cosine(array(0L), array(1L)) x").first().x == 0


def test_scaler_equals_numpy(names):
    e = minhash.batch_encode(names).repartition(5)
    mean, scale = scaler.collected(scaler.fit_scaler(e))
    x = np.array([py_signature(n) for n in NAMES], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(mean, x.mean(0), atol=1e-12) and np.allclose(scale, x.std(0), atol=1e-10)
    z = {r.id: r.z for r in scaler.standardised(e, mean, scale).collect()}
    assert np.allclose([z[i] for i in range(len(NAMES))], (x - x.mean(0)) / x.std(0), atol=1e-6)
    one = scaler.collected(scaler.fit_scaler(e.where("id = 0")))
    assert (one[1] == 1).all()


def numpy_kmeans(x, k, rounds=20):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    c = unit(x[seed_positions(len(x), k)])
    for _ in range(rounds):
        sims = unit(x) @ unit(c).T
        best = sims.argmax(1)
        new = c.copy()
        for j in range(k):
            v = x[best == j].mean(0) if (best == j).any() else x[np.argmax(1 - sims[np.arange(len(x)), best])]
            if np.linalg.norm(v) >= 1e-10:
                new[j] = v / np.linalg.norm(v)
        done = np.linalg.norm(new - c, axis=1).max() < 1e-8
        c = new
        if done:
            break
    return c, (unit(x) @ unit(c).T).argmax(1)


@pytest.mark.parametrize("k,copies", [(1, False), (5, False), (6, True), (20, False)])
def test_kmeans_equals_numpy(spark, k, copies):
    x = np.random.default_rng(k).normal(size=(60, 8))
    if copies:
        x[20:] = x[0]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, z array<double>").repartition(4)
    c = kmeans.fit(points, k)
    want, labels = numpy_kmeans(x, k)
    assert np.allclose(c, want, atol=1e-9)
    got = {r.id: r.cluster_id for r in kmeans.assign(points, c).collect()}
    assert [got[i] for i in range(60)] == labels.tolist()


def test_end_to_end(spark):
    for query, caught in (("john smith", True), ("zzzz qqqq", False)):
        run = protocol.run_single_query(["john smith", "mary jones"], query, spark, Options(early_stop=False))
        assert run.result.columns == ["query_id", "catch"] and run.result.first().catch is caught
        assert run.debug.first().checked_columns == 2 and run.index.centroids.shape == (1, 200) and run.index.max_size == 2


@pytest.fixture(scope="module")
def built(names):
    return index.build_index(names, 4)


def test_exact_copies_are_always_caught(spark, names, built):
    queries = names.select(F.col("id").alias("query_id"), "name")
    judged = search.screen(queries, built)
    assert judged.where("not catch").count() == 0
    linear = search.hits_linear(minhash.batch_encode(queries), minhash.batch_encode(names), block=7)
    caught = {r.query_id for r in linear.select("query_id").collect()}
    assert {r.query_id for r in judged.where("catch").collect()} <= caught
    x = np.array([py_signature(n)[:50] for n in NAMES], float)
    cos = x @ x.T / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    assert {(r.query_id, r.id) for r in linear.collect()} == {(i, j) for i in range(len(NAMES)) for j in range(len(NAMES)) if cos[i, j] - 0.9 > 1e-6}
    hit = search.first_hit(judged, built.members).where("query_id = 0").first()
    assert hit.matched_name == "john smith"
    for tau in (0, -1):
        with pytest.raises(ValueError):
            search.screen(queries, built, tau)


def test_misses_check_padded_columns_and_probes_add_hits(spark, names, built):
    asked = spark.createDataFrame([(0, "zzzz qqqq"), (1, "harold grnt abbot")], "query_id bigint, name string")
    rows = {r.query_id: r for r in search.screen(asked, built).collect()}
    assert not rows[0].catch and rows[0].checked_columns == built.max_size and rows[0].first_positive_column is None
    probed = [search.probe(asked, built, p) for p in (1, built.k)]
    assert [p.count() for p in probed] == [2, 2 * built.k]
    few, every = (search.hits_clustered(p, built.members, 0.5, block=3).count() for p in probed)
    linear = search.hits_linear(minhash.batch_encode(asked), minhash.batch_encode(names), 0.5).count()
    assert 0 < few <= every == linear


def test_selector_product_equals_the_join(spark, built):
    picked = spark.createDataFrame([(0, 2), (1, 0)], "query_id bigint, cluster_id int").withColumn("selector", vector.one_hot(F.col("cluster_id"), built.k))
    oblivious = search.selector_product(picked, built.members).where("val <> 0")
    joined = picked.join(built.members, "cluster_id").select("query_id", "column_index", F.posexplode("sig50").alias("dim", "val"))
    assert sorted(map(tuple, oblivious.collect())) == sorted((r.query_id, r.column_index, r.dim, float(r.val)) for r in joined.where("val <> 0").collect())
    with pytest.raises(Exception, match="out of range"):
        picked.select(vector.one_hot(F.lit(9), 4)).collect()


def test_index_survives_writing(spark, built, tmp_path):
    index.save_index(built, str(tmp_path / "i"))
    again = index.load_index(spark, str(tmp_path / "i"))
    assert np.array_equal(again.centroids, built.centroids) and (again.n, again.k, again.max_size) == (built.n, built.k, built.max_size)
    assert sorted(map(str, again.members.select(built.members.columns).collect())) == sorted(map(str, built.members.collect()))
    assert [r.n for r in index.cluster_sizes(again.members, 6).orderBy("cluster_id").collect()][4:] == [0, 0]


def test_masks(spark):
    drawn = [r.m for r in spark.range(200).select(search.random_mask().alias("m")).collect()]
    assert all(1 <= m <= 10 for m in drawn) and len(set(drawn)) > 100
    fixed = spark.range(50).select(search.hash_mask(F.col("id")).alias("m"))
    assert fixed.collect() == fixed.collect() and all(1 <= r.m < 10 for r in fixed.collect())


def test_metrics(spark):
    rows = [(True, True)] * 6 + [(True, False)] * 2 + [(False, True)] * 4 + [(False, False)] * 8
    counts = metrics.confusion(spark.createDataFrame(rows, "predicted boolean, label boolean"))
    assert counts.first().asDict() == {"tp": 6, "fp": 2, "fn": 4, "tn": 8}
    m = metrics.metrics(counts).first()
    assert (m.precision, m.recall, m.accuracy) == (0.75, 0.6, 0.7) and m.f1 == pytest.approx(2 * 0.45 / 1.35)
    none = metrics.metrics(metrics.confusion(spark.createDataFrame([], "predicted boolean, label boolean"))).first()
    assert tuple(none) == (0, 0, 0, 0)
    v = spark.createDataFrame([(True, "a", "a", None), (True, "b", "a", None), (False, None, None, False), (True, "x", None, None)], "catch boolean, hit string, want string, label boolean")
    v = v.select(metrics.verdict(F.col("catch"), F.col("hit"), F.col("want"), F.col("label")).alias("correct"))
    assert [r.correct for r in v.collect()] == [True, False, True, None] and metrics.accuracy(v).first()[0] == pytest.approx(2 / 3)


def test_loaders(spark, tmp_path):
    folder = tmp_path / "ncvr_10k"
    folder.mkdir()
    (folder / "ncvr_10k_database.csv").write_text('ncid,full_name\nA,"SMITH, JOHN"\nB,  \nC,MARY JONES\n')
    (folder / "ncvr_10k_queries.csv").write_text("query_ncid,query_name,label\nA,JOHN SMITH,True\nB,NOBODY HERE,no\n")
    queries, database = datasets.load_dataset(spark, "NCVR_10K", str(tmp_path))
    assert [tuple(r) for r in database.orderBy("id").collect()] == [(0, "SMITH, JOHN"), (1, "MARY JONES")]
    assert [tuple(r) for r in queries.orderBy("query_id").collect()] == [(0, "JOHN SMITH", True), (1, "NOBODY HERE", False)]
    with pytest.raises(ValueError):
        datasets.load_dataset(spark, "nothing")
    with pytest.raises(ValueError):
        datasets.ncvr_paths(str(folder / "ncvr_10k_queries.csv"))
    with pytest.raises(FileNotFoundError):
        datasets.ncvr_paths(str(tmp_path / "absent"))
    (tmp_path / "bad.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError):
        datasets.read_queries(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "short.csv").write_text("query_name,label\nA,yes\n")
    (tmp_path / "blank.csv").write_text("ncid,full_name\nA, \n")
    (tmp_path / "mark.csv").write_text("\ufeffncid,full_name\nA,ANN LEE\n")
    for read, file in ((datasets.read_queries, "short.csv"), (datasets.read_database, "blank.csv")):
        with pytest.raises(ValueError):
            read(spark, str(tmp_path / file))
    assert [tuple(r) for r in datasets.read_database(spark, str(tmp_path / "mark.csv")).collect()] == [(0, "ANN LEE")]
    with pytest.raises(Exception, match="not a boolean"):
        spark.sql("select 'maybe' x").select(datasets.parse_bool(F.col("x"))).collect()
    sizes = {n: tuple(x.count() for x in datasets.load_dataset(spark, n)) for n in ("ncvr", "libcat", "census", "forenames")}
    assert sizes == {"ncvr": (100, 1000), "libcat": (80, 2000), "census": (50, 500), "forenames": (100, 1000)}
    q, b = (x.collect() for x in datasets.load_dataset(spark, "census"))
    assert [q[i].name for i in (0, 8, 19, 20, 49)] == ["Smith", "Smith", "Brown", "Random_20", "Random_49"]
    assert [b[i].name for i in (0, 19, 20, 49, 50, 499)] == ["Smith", "Brown", "Random_120", "Random_149", "Extra_50", "Extra_499"]
    q, b = datasets.load_dataset(spark, "census", query_limit=5, db_limit=7)
    assert (q.count(), b.count()) == (5, 7) and datasets.pick(q, [1, 3], 5).count() == 2
    with pytest.raises(ValueError):
        datasets.pick(q, [5], 5)


def test_synthetic_forenames(spark):
    pool = spark.range(400).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("Romanized Name"))
    q, b = datasets.synthesise_forenames(pool, 100, 30, 20)
    assert (q.where("label").count(), q.where("not label").count(), b.select("name").distinct().count()) == (30, 20, 100)
    assert q.where("not label").join(b, "name").count() == 0 and 10 < q.where("label").join(b, "name").count() <= 30
    assert sorted(q.collect()) == sorted(datasets.synthesise_forenames(pool.repartition(7), 100, 30, 20)[0].collect())


def test_benchmark_and_report(spark, tmp_path):
    result = benchmark.benchmark(spark, {"dataset": "census", "k_mode": "sqrt", "use_mock": True, "reuse_context": False})
    assert result["timing_sec"].keys() == {"offline", "online_total", "avg_round1", "avg_round2"} and result["memory_peak_mb"] > 0
    with pytest.raises(ValueError):
        benchmark.benchmark(spark, {"el_match": 10})
    assert result["metrics"]["recall"] == 1.0 and sum(result["confusion"].values()) == 50 and result["communication_mb"]["total"] > 0
    files = reports.save_report(result, str(tmp_path), "run")
    assert {f.suffix for f in files} >= {".json", ".csv"} and all(f.stat().st_size for f in files)
    with pytest.raises(ValueError):
        benchmark.benchmark(spark, {"no_such": 1})


def test_report_rows_and_events(spark, tmp_path):
    row = spark.createDataFrame([(0.5, 1.0)], "precision double, recall double")
    assert [tuple(r) for r in reports.unpivoted(row, ["precision", "recall"], "metric").collect()] == [("precision", 0.5), ("recall", 1.0)]
    event = reports.events(row, 3, "score", "B", ["recall"], 1.5).first()
    assert (event.step, event.party, event.data) == (3, "B", '{"recall":1.0}')
    reports.save_rows(row, str(tmp_path / "rows"))
    assert spark.read.json(str(tmp_path / "rows")).count() == 1


def test_projection(spark):
    x = np.random.default_rng(0).normal(size=(400, 6))
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id bigint, z array<double>, cluster_id int")
    rows = projection.project_3d(df).collect()
    assert len(rows) == 300 and max(abs(r.x) for r in rows) == pytest.approx(1.0)
    assert len(projection.project_3d(df, cluster=None, max_points=50).collect()) == 50


def test_plain_cipher_and_boundary(spark, built):
    c = cipher.backend("plain")
    x, y = np.array([1.0, 2.0]), np.array([3.0, 4.0])
    cx, cy = c.encrypt(x), c.encrypt(y)
    assert not c.confidential and c.decrypt(c.dot(cx, cy))[0] == c.decrypt(c.dot_plain(cx, y))[0] == 11
    assert c.decrypt(c.matmul_plain(cx, np.eye(2))).tolist() == [1, 2] and c.decrypt(c.add_plain(cx, y)).tolist() == [4, 6] and c.decrypt(c.mul_plain(cx, y)).tolist() == [3, 8]
    with pytest.raises(ValueError):
        c.dot_plain(cx, np.ones(3))
    with pytest.raises(TypeError):
        c.decrypt(x)
    with pytest.raises(ValueError):
        cipher.backend("none")
    assert cipher.error_probe(c, 5)["ct_ct"]["max"] < 1e-12 and cipher.sign_stability(np.array([0.1, 0.95]), 0.9) == 0
    asked = spark.createDataFrame([(0, "john smith")], "query_id bigint, name string")
    request, state = protocol.first_round(asked, built, c)
    assert request.columns == ["query_id", "ctx", "ct200"] and state.columns == ["query_id", "ct50"]
    assert len(c.decrypt(bytes(request.first().ct200))) == 200
    assert np.linalg.norm(state.select(cipher.decrypted(F.col("ct50")).alias("v")).first().v) == pytest.approx(1.0)


def test_tenseal_cipher():
    pytest.importorskip("tenseal")
    secret, public = cipher.key_pair("tenseal")
    c = cipher.backend(secret)
    assert all(v["max"] < 1e-4 for v in cipher.error_probe(c, 5).values())
    with pytest.raises(Exception):
        cipher.backend(public).decrypt(c.encrypt(np.ones(3)))


def test_stream_equals_batch(spark, names, built, tmp_path):
    asked = names.select(F.col("id").alias("query_id"), "name")
    asked.repartition(3).write.parquet(str(tmp_path / "in"))
    got = []
    arriving = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming.screen_stream(arriving, built, lambda df, n: got.extend(df.collect()), str(tmp_path / "c"), once=True)
    q.awaitTermination(120)
    assert sorted(got) == sorted(search.public(search.screen(asked, built)).collect())


def test_idempotent_cleaning(names):
    twice = names.withColumn("once", text.clean_name(F.col("name"))).withColumn("twice", text.clean_name(F.col("once")))
    assert twice.where("once <> twice").count() == 0
    shown = names.where("id = 7").select(text.sorted_shingles(F.lit("banana")).alias("s"), text.yes_no(F.lit(True)).alias("y"), text.yes_no(F.lit(None).cast("boolean")).alias("n")).first()
    assert (shown.s, shown.y, shown.n) == (["ana", "ban", "nan"], "Y", None) and text.positions("2, 7,,26") == [2, 7, 26]


@pytest.mark.parametrize("early_stop", [True, False])
def test_rounds_on_ciphertexts_equal_the_screening(spark, names, built, early_stop):
    asked = names.select(F.col("id").alias("query_id"), "name").union(spark.createDataFrame([(90, "zzzz qqqq"), (91, "harold grnt abbot")], "query_id bigint, name string"))
    run = rounds.run_encrypted(asked, built, early_stop=early_stop)
    want = {r.query_id: r for r in search.screen(asked, built, early_stop=early_stop).collect()}
    got = {r.query_id: r for r in run.debug.collect()}
    assert got.keys() == want.keys()
    for i, r in got.items():
        assert all(r[c] == want[i][c] for c in ("catch", "first_positive_column", "checked_columns", "selected_cluster"))
    assert run.result.columns == ["query_id", "catch"]
    sizes = run.messages.first()
    assert (sizes.sent, sizes.received) == (8 * (200 + 50 + built.k), 8 * (built.k + built.max_size))


def test_messages_tell_the_answering_party_nothing_in_the_clear(spark, built):
    asked = spark.createDataFrame([(0, "john smith")], "query_id bigint, name string")
    request, state = protocol.first_round(asked, built, cipher.backend("plain"))
    reply = rounds.first_reply(request, built.centroids)
    second, chosen = rounds.second_request(rounds.decrypted_scores(reply), state, built.k)
    assert second.columns == ["query_id", "ct50", "selector"] and chosen.columns == ["query_id", "selected_cluster"]
    selector = cipher.backend("plain").decrypt(bytes(second.first().selector))
    assert selector.sum() == 1 and selector[chosen.first().selected_cluster] == 1
    small = rounds.second_reply(second, built.members, built.k, built.max_size, columns=2, queries=1)
    one, two = ([r.masked for r in small.orderBy("column_index").collect()] for _ in range(2))
    assert len(one) == built.max_size and one != two  # masks are fresh
    assert [np.frombuffer(x, "<f8")[0] > 0 for x in one] == [np.frombuffer(x, "<f8")[0] > 0 for x in two]
    with pytest.raises(ValueError):
        rounds.second_reply(second, built.members, built.k, built.max_size, tau=0)


@pytest.mark.parametrize("bad", [[0.0, 0.0], [1.0, 1.0], [0.5, 0.5], [float("nan"), 1.0], [float("inf"), 0.0], [2.0, -1.0]])
def test_selectors_must_be_one_hot(spark, bad):
    one = lambda v: spark.createDataFrame([(v,)], "s array<double>")
    assert one([0.0, 1.0]).select(rounds.valid_selector(F.col("s")).alias("s")).first().s == [0.0, 1.0]
    with pytest.raises(Exception, match="one-hot"):
        one(bad).select(rounds.valid_selector(F.col("s"))).collect()
    assert one([1.0, 3.0, 3.0]).select(rounds.best_cluster(F.col("s"), 3).alias("c")).first().c == 1
    for scores in ([1.0, float("nan"), 0.0], [1.0], [1.0, float("inf"), 0.0]):
        with pytest.raises(Exception, match="finite"):
            one(scores).select(rounds.best_cluster(F.col("s"), 3)).collect()


def test_least_hits_are_the_first_of_all_hits(names):
    e = minhash.batch_encode(names)
    asked = minhash.batch_encode(names.select(F.col("id").alias("query_id"), "name"))
    every = search.hits_linear(asked, e, 0.5, block=4)
    least = search.hits_linear(asked, e, 0.5, block=4, least=True)
    first = lambda df: sorted(map(tuple, df.groupBy("query_id").agg(F.min("id")).collect()))
    assert first(every) == first(least) and least.count() < every.count()


def test_columns_are_ranks_whatever_the_cells(spark):
    rows = [(i * 7 - 300, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, cluster_id int").repartition(5)
    got = {(r.cluster_id, r.id): r.column_index for r in index.column_index(df, cell=50).collect()}
    for c in range(3):
        assert [got[c, i] for i in sorted(i for i, k in rows if k == c)] == list(range(sum(k == c for _, k in rows)))
    summary = index.size_summary(index.cluster_sizes(df, 4)).first()
    assert (summary.least, summary.most, summary["mean"]) == (0, 67, 50.0)


def test_error_study_covers_decisions_near_the_threshold():
    study = cipher.error_study(cipher.backend("plain"), 60)
    assert study.keys() == {"ct_pt_abs_error", "ct_ct_abs_error", "threshold_failure_rate"}
    assert all(v["max"] < 1e-12 for v in study.values()) and "no decision turned over" in cipher.study_report(study)


def test_steps_and_rows_of_a_demonstration(spark):
    names = spark.createDataFrame(list(enumerate([right for right, _ in demo.PAIRS] + NAMES)), "id bigint, name string")
    *events, done = demo.steps(demo.demo_queries(spark), names, 3)
    assert [e["step"] for e in events] == [1, 2, 3, 4, 5, 6] and {e["party"] for e in events} == {"A", "B"} and events[0]["data"]["records"] == 25
    assert len(done["rows"]) == 13 and all(list(r) == demo.COLUMNS for r in done["rows"])
    exact = [r for r in done["rows"] if r["query_index"] in (0, 2, 4, 6, 8)]
    assert all(r["predicted_match"] and r["matched_name"] == r["query_name"] for r in exact)
    assert 0 < done["summary"]["accuracy"] <= 1
    shown = cli.matches(spark.createDataFrame([(True, False)], "expected_label boolean, predicted_match boolean")).first()
    assert tuple(shown) == ("Y", "N")


def test_command_line_and_server(spark, tmp_path, capsys):
    folder = tmp_path / "ncvr_10k"
    folder.mkdir()
    (folder / "ncvr_10k_database.csv").write_text("ncid,full_name\n" + "".join(f"{i},{n}\n" for i, n in enumerate(["JOHN SMITH", "MARY JONES", "HAROLD GRANT ABBOTT"])))
    (folder / "ncvr_10k_queries.csv").write_text("query_ncid,query_name,label\nA,JOHN SMITH,true\nB,NOBODY HERE,false\n")
    data = ["--data-path", str(tmp_path)]
    assert cli.main(["evaluate", *data, "--k", "1", "--output-dir", str(tmp_path / "e")], spark) == 0
    assert json.loads((tmp_path / "e" / "ncvr_10k_result.json").read_text())["metrics"]["accuracy"] == 1.0
    assert cli.main(["demo", *data, "--k", "1", "--query-indices", "0,1", "--output-dir", str(tmp_path / "d")], spark) == 0
    saved = json.loads((tmp_path / "d" / "demo.json").read_text())
    assert [r["predicted_match"] for r in saved["rows"]] == [True, False] and (tmp_path / "d" / "demo.csv").read_text().startswith("query_index,query_name")
    assert cli.main(["card", *data], spark) == 0
    card = json.loads(capsys.readouterr().out.split("demo.csv")[-1])
    assert (card["total_records_b"], card["positive_queries"], card["sample_queries_a"][1]["name"]) == (3, 1, "NOBODY HERE")
    served = cli.server(spark, cli.parser().parse_args(["serve", *data, "--port", "0"]))
    threading.Thread(target=served.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{served.server_port}"
        assert json.loads(urllib.request.urlopen(f"{at}/api/dataset-info", timeout=120).read()) == card
        body = json.dumps({"query_mode": "text", "query": "JOHN SMITH", "k": 1}).encode()
        stream = urllib.request.urlopen(urllib.request.Request(f"{at}/api/run", body), timeout=120).read().decode()
        assert [x.split("\n")[0] for x in stream.split("\n\n") if x] == ["event: step_complete"] * 6 + ["event: complete"]
        assert json.loads(stream.split("data: ")[-1])["rows"][0]["matched_name"] == "JOHN SMITH"
    finally:
        served.shutdown()
