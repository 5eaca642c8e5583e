"""Keys of one pair for all tasks, and a stream that remembers its verdicts."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesieve import cipher, streaming
from namesieve.operators import index, search
from namesieve.plans import rounds


class Keyed(cipher.PlainCipher):
    """Plain numbers behind the number of a key: fails across keys, and decrypts with the secret one alone."""

    confidential = True

    def __init__(self, context=None):
        self.context = context or b"S" + os.urandom(8)

    def secret_context(self):
        return self.context

    def public_context(self):
        return b"P" + self.context[1:]

    def encrypt(self, vector):
        return self.context[1:] + super().encrypt(vector)

    def _open(self, data):
        if data[:8] != self.context[1:]:
            raise ValueError("a ciphertext of another key")
        return super().decrypt(data[8:])

    def decrypt(self, data):
        if self.context[:1] != b"S":
            raise ValueError("a public key cannot decrypt")
        return self._open(data)

    def dot_plain(self, data, vector):
        return self.encrypt(self._open(data) @ np.asarray(vector, float))

    def dot(self, x, y):
        return self.dot_plain(x, self._open(y))

    def matmul_plain(self, data, matrix):
        return self.encrypt(self._open(data) @ np.asarray(matrix, float))

    def add_plain(self, data, vector):
        return self.encrypt(self._open(data) + vector)

    def mul_plain(self, data, vector):
        return self.encrypt(self._open(data) * vector)


NAMES = ["john smith", "mary jones", "harold grant abbott", "zoe quigley", "nathan edward aaron", "timothy duane armstrong"]


@pytest.fixture(scope="module")
def built(spark):
    return index.build_index(spark.createDataFrame(list(enumerate(NAMES)), "id bigint, name string"), 2)


@pytest.fixture
def asked(spark):
    return spark.createDataFrame([(0, "John Smith"), (1, "zzzz qqqq"), (2, "NATHAN EDWARD AARO")], "query_id bigint, name string").repartition(3)


def test_rounds_work_with_one_pair_of_keys_in_all_tasks(built, asked):
    secret, public = cipher.key_pair(Keyed)
    got = rounds.run_encrypted(asked, built, name=(secret, public))
    want = search.screen(asked, built)
    assert sorted(map(tuple, got.result.collect())) == sorted((r.query_id, r.catch) for r in want.collect())
    assert sorted(map(tuple, rounds.run_encrypted(asked, built, name=Keyed).result.collect())) == sorted(map(tuple, got.result.collect()))


def test_other_keys_and_public_ones_open_nothing(spark, built, asked):
    (secret, public), (other, _) = cipher.key_pair(Keyed), cipher.key_pair(Keyed)
    sealed = asked.select("query_id", cipher.encrypted(F.array(F.lit(1.0), F.lit(2.0)), secret).alias("ct"))
    assert [list(r.v) for r in sealed.select(cipher.decrypted(F.col("ct"), secret).alias("v")).collect()] == [[1.0, 2.0]] * 3
    for key, said in ((other, "another key"), (public, "public key")):
        with pytest.raises(Exception, match=said):
            sealed.select(cipher.decrypted(F.col("ct"), key)).collect()
    request = asked.select("query_id", cipher.encrypted(F.array(*[F.lit(0.1)] * 200), secret).alias("ct200"))
    reply = rounds.first_reply(request, built.centroids, public)  # the answering party needs no secret
    assert reply.count() == 3
    with pytest.raises(Exception, match="public key"):
        rounds.decrypted_scores(reply, public).collect()
    with pytest.raises(ValueError, match="key_pair"):
        cipher.SCHEMES["keyed"] = Keyed
        try:
            cipher.backend("keyed")
        finally:
            del cipher.SCHEMES["keyed"]


def test_a_stream_answers_repeats_from_its_memory_after_a_restart(spark, built, tmp_path):
    (tmp_path / "in").mkdir()

    def arrive(k, names):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(f'{{"query_id": {100 * k + i}, "name": "{n}"}}' for i, n in enumerate(names)))

    results = {}

    def sink(df, number):
        for r in df.collect():
            results[r.query_id] = r.catch

    def run(ix):
        arriving = spark.readStream.schema("query_id bigint, name string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        streaming.screen_stream(arriving, ix, sink, str(tmp_path / "check"), once=True, memory=str(tmp_path / "memory"), ttl_seconds=3600).awaitTermination()

    arrive(0, ["John Smith", "nobody here", "john  smith!", "Mary Jones"])
    run(built)
    assert results == {0: True, 1: False, 2: True, 3: True}
    hollow = index.Index(built.centroids, built.mean, built.scale, built.members.limit(0), built.n, built.max_size)
    arrive(1, ["MARY JONES", "Nobody Here", "harold grant abbott"])
    run(hollow)  # after a restart: what was judged is remembered, what is new meets an index without members
    assert {k: v for k, v in results.items() if k >= 100} == {100: True, 101: False, 102: False}
    verdicts = spark.read.schema(streaming.VERDICTS).parquet(str(tmp_path / "memory")).groupBy("batch").count().collect()
    assert {r.batch: r["count"] for r in verdicts} == {0: 3, 1: 1}
    df = spark.createDataFrame([(7, "Mary Jones"), (8, None)], "query_id bigint, name string")
    again = [streaming.remembered(df, built, str(tmp_path / "memory"), 1, ttl).collect() for ttl in (3600, 3600, 0)]
    assert [[tuple(r) for r in x] for x in again] == [[(7, True, True)], [(7, True, True)], [(7, True, False)]]
