"""The Merkle manifest against a plain tree, with odd data."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from namesieve.llm import manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, pos int, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    """The root, and for each node the siblings before and behind it at each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = i // 16 * 16
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 16])))
        at = [i // 16 for i in at]
        nodes = [sha("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    tops, inner = [], []
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        top, paths = tree([leaf(r, r[1]) for r in groups[k]])
        tops.append(top)
        inner.append(paths)
    if not tops:
        return []
    root, outer = tree(tops)
    out = []
    for k, top, paths, up in zip(keys, tops, inner, outer):
        for r, path in zip(groups[k], paths):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            fold = leaf(r, text)
            for before, behind in path + up:
                fold = sha(before + fold + behind)
            out.append((r[0], leaf(r, r[1]), top, root, "".join(b + h for b, h in path + up), fold, fold == root))
    return out


def run(spark, rows, parts=5):
    docs = spark.createDataFrame([(*r, "k", 1, "l") for r in rows], SCHEMA).repartition(parts)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    built = manifest.build(docs, FIELDS, changed={"text": low}, where=F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    return sorted((tuple(r) for r in manifest.prove(built).collect()), key=str)


def made(sizes, seed=1):
    rnd = random.Random(seed)
    ids = iter(rnd.sample(range(10**6), sum(sizes.values())))
    return [(next(ids), rnd.choice((None, "", "Tüx A", "lower", "Über alles É")), rnd.choice((None, "en")), source, rnd.choice((None, 5))) for source, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2}, {"a": 16}, {"a": 17}, {"a": 256, "b": 257, None: 1, "": 15, "ä": 33, "z": 1}, {"s": 5000, "t": 4096, "u": 4097}, {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_proofs_equal_a_plain_tree(spark, sizes):
    rows = made(sizes)
    got = run(spark, rows)
    assert got == sorted(plain(rows), key=str)
    assert {r[6] for r in got} == {True, False} or len(rows) < 40


def test_repeated_rows_null_and_shared_ids_long_texts(spark):
    rows = [(7, "Same", "en", "s", 4)] * 5000 + [(None, "Null", None, "s", 1)] * 40 + [(7, f"Other {i}", None, "s", 2) for i in range(30)] + [(1, "Long " * 500_000, None, None, None)]
    assert run(spark, rows) == sorted(plain(rows), key=str)


def test_no_rows(spark):
    assert run(spark, []) == []


def test_places_are_prefix_sums_however_rows_are_dealt(spark):
    rows = spark.createDataFrame([(f"g{i % 3}", i * 7919 % 5000) for i in range(5000)] + [("one", 1)] * 900, "g string, x int").repartition(7)
    got = manifest.numbered(rows, "g", [F.asc("x")]).collect()
    for g in {r.g for r in got}:
        mine = sorted((r.pos, r.x, r.n) for r in got if r.g == g)
        assert [p for p, *_ in mine] == list(range(len(mine))) and [x for _, x, _ in mine] == sorted(x for _, x, _ in mine) and {n for *_, n in mine} == {len(mine)}
