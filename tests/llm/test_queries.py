import random
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from namesieve.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.sql(queries.ORACLES[name]).df()
    by = sorted(got.columns)
    assert got[by].sort_values(by).to_numpy().tolist() == want[by].sort_values(by).to_numpy().tolist()


def test_pipeline_packs_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns and out.count() <= kept.count(), name
        kept = out
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids
    assert 0.7 * docs.count() < len(ids) < docs.count()


def test_pipeline_on_no_documents_and_on_odd_ones(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(1, None, None, None, None), (2, "", None, "s", 0), (3, "only one document of words", "en", "s", 5), (3, "only one document of words", "en", "s", 5)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        assert {r.doc_id for r in docs.collect()} <= {3}


def test_pipeline_on_rows_without_a_doc_id_or_with_a_shared_one(spark, tmp_path):
    """Every stage's decision is known beforehand; the packed ids must be those of the texts that are left."""
    rnd = random.Random(61)
    sounds = {"aa": ("ta", "ko", "mi", "lu", "re"), "bb": ("schu", "rf", "xel", "ont", "ig"), "zz": ("gwy", "ddl", "pqe", "yff")}
    text = lambda lang, n=40: " ".join("".join(rnd.choice(sounds[lang]) for _ in range(4)) for _ in range(n))
    item = text("aa", 20)
    plain = [(i, text(("aa", "bb")[i % 2]), ("aa", "bb")[i % 2]) for i in range(200)]
    a, b, c = text("aa"), text("bb"), text("aa")
    near = " ".join([*a.split()[:-1], "talumikore"])
    rows = [*plain, (300, a, "aa"), (301, a, "aa"), (301, b, "bb"), (302, near, "aa"), (None, c, "aa"), (None, f"{text('aa', 9)} {item} {text('aa', 9)}", "aa"), (None, c, None), (303, text("zz"), "aa"), (304, f"{text('bb', 20)} call +1 (212) 555-0100 now", "bb")]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = [t for _, t, _ in plain] + [a, b, c, rows[-1][1].replace("+1 (212) 555-0100", "<PHONE>")]
    encode = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")).encode
    crc = sorted(zlib.crc32(np.array(encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes()) for t in want)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.start == 0 for r in got) and sorted(r.ids_crc32 for r in got) == crc
    assert sorted((r.doc_id for r in got if r.doc_id is None or r.doc_id >= 300), key=str) == [300, 301, 304, None]
