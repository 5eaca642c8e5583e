"""Operators against brute force on small tables."""

import bisect
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from namesieve.llm import _counts, decontam, fingerprint, langid, lmscore, neardup, packing, pii, queries, repeats, tokenbin, urlrules
from namesieve.llm._spark import components, identified
from namesieve.llm._text import Words, code_points, stream
from namesieve.llm.tokens import Encoder

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sun", "vor", "del") for b in ("ra", "net", "sol", "mik", "tan", "pel", "ox", "ir", "und", "abe")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    rows = [(i, prose(rnd, rnd.randint(20, 120)), "xx" if i % 2 else "yy") for i in range(60)]
    rows += [(100 + i, rows[i][1], "xx") for i in range(6)]  # copies
    for i in range(6, 16):  # near copies
        w = rows[i][1].split()
        w[len(w) // 2] = "zebra"
        rows.append((110 + i, " ".join(w), "yy"))
    passage = prose(rnd, 60).capitalize() + "."
    rows += [(200 + i, f"{prose(rnd, 15)} {passage} {prose(rnd, 15)}", "xx") for i in range(4)]
    rows += [(300, None, "xx"), (301, "", None), (302, "!!! ... 12", None), (303, "a", "xx"), (304, prose(rnd, 30000), "yy"), (304, "twice the same number", "yy"), (None, "no number at all", "xx"), (305, "é ß Ñandú  x", "xx")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    rows = [(*r, "k", 1, 2.0, 3) for r in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, chunk string, unit int, score double, k int").repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_words_split_and_fold():
    w = Words(pa.array(["Ab,c É\u00a0x", None, "", "ab C é X y z"]))
    assert w.rows.tolist() == [0, 4, 4, 4, 10]
    assert w.hash[:4].tolist() == w.hash[4:8].tolist()
    assert code_points(np.frombuffer("aé".encode(), np.uint8)).tolist() == [0, 1, 2, 2]
    s, rows = w.shingles(5)
    assert rows.tolist() == [0, 1, 1, 1, 3]


def test_long_words_that_differ_by_a_swap_have_hashes_of_their_own():
    long = "".join(random.Random(2).choices("abcdefgh", k=5000))
    swapped = [long]
    for at, far in ((10, 1024), (3, 2048), (700, 3072)):
        x = list(long)
        x[at], x[at + far] = "y", "z"
        y = list(x)
        y[at], y[at + far] = "z", "y"
        swapped += ["".join(x), "".join(y)]
    w = Words(pa.array(swapped))
    assert len(set(w.hash.tolist())) == len(swapped) and len(w.hash) == len(swapped)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    rnd = random.Random(3)
    signs = ["a", "b", " ", " ", "'", "é", "\n", "\t", "\u00a0", "\u3000", "日", "1", ".", "s", "\u0301", "\u2003", "İ", ",", "S", "ß", "×", "я", "<|endoftext|>", "<|ENDOFTEXT|>", "!", "\x01", "'s"]
    texts = ["", "x's   y", "İ,a ×b ÷c"] + ["".join(rnd.choice(signs) for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    encoder = Encoder(queries.tokenizer_path(name), cache=500)
    ids, rows = encoder.encode(pa.array(texts))
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])] == want


def test_token_files_round_trip(spark, docs, corpus, none):
    path = queries.tokenizer_path("word_bpe_49k.json")
    encode = Encoder(path).tokenizer.encode
    got = tokenbin.read_token_files(spark, tokenbin.write_token_files(docs, path), with_ids=True).collect()
    start, want = 0, []
    for i, text, *_ in sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenbin.read_token_files(spark, tokenbin.write_token_files(none, path)).count() == 0


def best_fit_decreasing(lengths, size):
    """Number of sequences, piece by piece."""
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        if i < len(gaps):
            left = gaps.pop(i) - n
        else:
            left, opened = size - n, opened + 1
        if left:
            bisect.insort(gaps, left)
    return opened


def test_packing_equals_best_fit_decreasing(docs, corpus, none):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    encode = Encoder(path).tokenizer.encode
    got = packing.pack(docs, path, size=256).collect()
    assert sum(r.length for r in got) == sum(len(encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in corpus)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= 1.01 * best_fit_decreasing([r.length for r in got], 256) + 1
    ids = {r.doc_id: encode("".join(t for i, t, *_ in corpus if i == r.doc_id), add_special_tokens=False).ids + [2] for r in got if r.doc_id in range(60)}
    for r in got:
        if r.doc_id in ids:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack(none, path).count() == 0


@pytest.mark.parametrize(("size", "low", "high", "n"), [(1024, 1, 1024, 1500), (1024, 150, 400, 800), (64, 1, 20, 400), (8, 1, 8, 60)])
def test_packing_rounds_use_about_as_many_sequences_as_piecewise_best_fit(spark, monkeypatch, size, low, high, n):
    monkeypatch.setattr(packing, "SWEEP_ROWS", 100)  # so that pieces and gaps meet across partitions too
    rnd = random.Random(size + low)
    lengths = [rnd.randint(low, high) for _ in range(n)]
    parts = spark.createDataFrame([(i % 7, x, "clash") for i, x in enumerate(lengths)], "doc_id long, length long, pid string").repartition(3)
    got = packing.assign(parts, size)
    assert got.columns == ["doc_id", "length", "pid", "sequence_id", "offset"]
    used = collections.defaultdict(list)
    for r in got.collect():
        used[r.sequence_id].append((r.offset, r.length))
    assert sorted(x for b in used.values() for _, x in b) == sorted(lengths)
    for b in used.values():
        b.sort()
        assert all(o == sum(x for _, x in b[:i]) for i, (o, _) in enumerate(b)) and sum(x for _, x in b) <= size
    assert len(used) <= 1.01 * best_fit_decreasing(lengths, size) + 1


def test_slots_left_over_are_matched_across_partitions_like_by_one_sweep():
    rnd = random.Random(5)
    for _ in range(200):
        ends = [(p, rnd.randint(0, 6), rnd.randint(0, 6)) for p in range(rnd.randint(1, 8))]
        want, stack = {}, []
        for p, pieces_left, slots_left in ends:  # a partition's pieces left over stand before its slots
            for rank in range(pieces_left):
                if stack:
                    want[p, rank] = stack.pop()
            stack += [(p, rank) for rank in range(slots_left)]
        got = {(p, rank): (owner, top - (rank - low)) for p, low, high, owner, top in packing.across(ends) for rank in range(low, high)}
        assert got == want


def test_packing_refuses_pieces_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        packing.assign(spark.createDataFrame([(1, 9)], "doc_id long, length long"), 8)


def brute_classes(rows):
    """(doc_id, class_id) of rows (doc_id, text), from the weighted similarity of all pairs."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append(collections.Counter(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if w else {})
    df = collections.Counter(g for x in sets for g in x)
    weighted = [{g: (1 + np.log(n)) * (np.log(len(rows) / df[g]) + 1) for g, n in x.items()} for x in sets]
    total = [sum(x.values()) for x in weighted]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = weighted[i], weighted[j]
        if a and b:
            low = sum(min(x, b[g]) for g, x in a.items() if g in b)
            if low / (total[i] + total[j] - low) >= 0.8:
                root[top(j)] = top(i)
    first = {}
    for k, (i, _) in enumerate(rows):
        first.setdefault(top(k), []).append((i is None, i or 0, i))
    return [(i, min(first[top(k)])[2]) for k, (i, _) in enumerate(rows)]


ORDER = lambda r: tuple((x is not None, x or 0) for x in r)


def test_near_duplicates_equal_brute_force(docs, corpus, none):
    want = sorted(brute_classes([r[:2] for r in corpus]), key=ORDER)
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs).collect()), key=ORDER)
    assert got == want
    many = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(docs, chunk_chars=20_000, bucket_items=3000).collect()), key=ORDER)
    assert many == want
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id between 100 and 105").count() == 0 and kept.where("doc_id = 304").count() == 2
    assert neardup.near_duplicates(none).count() == 0 and neardup.keep_first(none).count() == 0


def test_rows_that_share_a_doc_id_lose_no_text(spark):
    rnd = random.Random(22)
    a, b, c = (prose(rnd, 30) for _ in range(3))
    rows = [(5, a), (1, a), (5, b), (None, b), (None, c), (None, c), (7, c), (None, None), (None, None), (1, a)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, row string").repartition(3)
    kept = [(r.doc_id, r.text) for r in neardup.keep_first(df).collect()]
    assert sorted(kept, key=lambda r: (r[0] is None, str(r))) == sorted([(1, a), (5, b), (7, c), (None, None), (None, None)], key=lambda r: (r[0] is None, str(r)))
    got = sorted(((r.doc_id, r.class_id) for r in neardup.near_duplicates(df).collect()), key=ORDER)
    assert got == sorted([(5, 1), (1, 1), (5, 5), (None, 5), (None, 7), (None, 7), (7, 7), (None, None), (None, None), (1, 1)], key=ORDER)
    tagged, key = identified(df)
    assert key == "row_" and tagged.select(key).distinct().count() == len(rows)
    alone, key = identified(df.where("doc_id = 7"))
    assert [r[key] for r in alone.collect()] == [7]


@pytest.mark.parametrize("likeness", [0.5, 0.8, 0.95])
def test_samples_agree_as_often_as_sets_are_alike(likeness):
    """Draws come from tables; what that costs must be lost in the spread of 20,000 samples."""
    n, sizes = 400, (2000, 10)
    draw = neardup.Sampler(sizes[1])
    agree = []
    for k in range(sizes[0] // 20):
        h = stream(1000 + k, 2 * n)
        w = np.exp(np.random.default_rng(k).integers(0, 60, 2 * n) * neardup._STEP)  # weights on the steps, so that rounding moves nothing
        common = int(n * 2 * likeness / (1 + likeness))
        one, two = np.arange(n), np.r_[np.arange(common), np.arange(n, 2 * n - common)]
        got = [draw.sample(h[x], w[x], np.zeros(1, np.int64))[:, 0] for x in (one, two)]
        true = w[:common].sum() / (w[one].sum() + w[two].sum() - w[:common].sum())
        agree.append(((got[0] == got[1]).mean(), true))
    got, want = np.mean(agree, 0)
    assert abs(got - want) < 0.06


def test_document_counts_survive_their_code():
    n = np.array([1, 2, 300, 32767, 32768, 10**6, 10**11])
    assert np.allclose(neardup._log_counts()[neardup.code(n)], np.log(n), atol=6e-4)


@pytest.mark.parametrize(("chunks", "buckets"), [(1, 1), (3, 7), (5, 300)])
def test_block_counts_equal_plain_counts(chunks, buckets):
    rnd = np.random.default_rng(2)
    every = np.unique(rnd.integers(1, 1 << 56, 5000, np.uint64))
    held = [(np.sort(rnd.choice(every, rnd.integers(1, 3000), False)), ) for _ in range(chunks)]
    held = [(h, rnd.integers(1, 400, len(h))) for h, in held]
    sent = pa.concat_tables([_counts.cells(h, n, c, buckets) for c, (h, n) in enumerate(held)])
    back = pa.concat_tables([_counts.add(sent.filter(pa.compute.equal(sent["bucket"], b))) for b in sent["bucket"].unique().to_pylist()])
    want = collections.Counter()
    for h, n in held:
        for x, y in zip(h.tolist(), n.tolist(), strict=True):
            want[x] += y
    for c, (h, n) in enumerate(held):
        assert _counts.totals(back.filter(pa.compute.equal(back["chunk"], c)), n).tolist() == [want[x] for x in h.tolist()]
    with pytest.raises(RuntimeError):
        _counts.totals(back, np.zeros(1))


def test_cells_stay_linear_in_the_corpus():
    for chars in (10**8, 10**11, 10**14):
        chunks, buckets = _counts.grid(chars, chars // 6)
        assert chunks * buckets <= max(chars / 6 / 150, 1000) and chars / chunks <= 4e8


def test_large_bucket_of_many_classes_loses_no_link(spark, monkeypatch):
    """Stars cannot settle buckets whose members resemble their leaders less than each other; blocks do."""
    monkeypatch.setattr(neardup, "STARS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(24):
        w = list(base)
        for p in rnd.sample(range(200), 2 + i % 7):
            w[p] = f"e{i}x{p}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [frozenset(zip(*[t.split()[k:] for k in range(5)])) for _, t in rows]
    df = collections.Counter(g for s in sets for g in s)
    weight = {g: np.log(len(sets) / n) + 1 for g, n in df.items()}
    total = lambda s: sum(weight[g] for g in s)
    for i in range(24):
        for j in range(i):
            if total(sets[i] & sets[j]) / total(sets[i] | sets[j]) >= 0.8:
                assert got[i] == got[j]


@pytest.mark.parametrize("stars", [1, 2])
def test_near_copies_in_a_large_group_are_found(spark, monkeypatch, stars):
    """Edits of a frequent text outweigh what it shares with its copies; plain likeness links them, from leaders and in blocks."""
    monkeypatch.setattr(neardup, "STARS", stars)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rnd = random.Random(31)
    base = prose(rnd, 104).split()
    rows = [(1000 + i, prose(rnd, 60)) for i in range(300)]
    for i in range(30):  # 90 of 110 shingles are common to an edited copy and the text, far fewer to two edited copies
        w = list(base)
        w[10 + i], w[60 + i] = f"e{i}x", f"e{i}y"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(50)]
    texts = [pa.array([" ".join(base)]), pa.array([rows[300][1]])]
    codes = []
    for t in texts:
        df = collections.Counter(h for _, x in rows for h in neardup.Sets(pa.array([x])).hash.tolist())
        codes.append(pa.array([neardup.code(np.array([df[h] for h in neardup.Sets(t).hash.tolist()])).tobytes()], pa.binary()))
    (x, wx), (y, wy) = (neardup._weighted(t, c, len(rows), 5) for t, c in zip(texts, codes, strict=True))
    low = wx[np.isin(x.hash, y.hash)].sum()
    assert low / (wx.sum() + wy.sum() - low) < 0.75  # by weights alone they are not near
    assert neardup.similarities(*zip(texts, codes, strict=True), len(rows))[0] == pytest.approx(90 / 110)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {i: i if i >= 1000 else 0 for i, _ in rows}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 4), (20, 20)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_language_profiles(spark, none):
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        lang = ("aa", "bb")[i % 2]
        sounds = ("ta", "ko", "mi") if lang == "aa" else ("schu", "rf", "xel")
        rows.append((i, " ".join("".join(rnd.choice(sounds) for _ in range(3)) for _ in range(20)), lang if i % 10 else None))
    rows += [(900, None, "aa"), (901, "12 !!", "bb"), (902, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.fit(df, ~langid.held_out())
    got = by_id(langid.predict(df, profiles).withColumn("held_out", langid.held_out()))
    for i, text, _ in rows[:200]:
        assert got[i].lang_pred == ("aa", "bb")[i % 2] and 0 <= got[i].score <= 1
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert langid.fit(none, ~langid.held_out()) == {} and langid.predict(none, {}).count() == 0
    assert langid.judge(["text"], {}) == (["und"], [0.0])
    # out-of-place distance by hand
    grams = langid.ranked("ab ab").tolist()
    assert langid.judge(["ab ab"], {"x": grams})[1] == [1.0]
    assert len(grams) == len(set(grams)) == 7


def test_out_of_place_distance_equals_a_plain_one():
    rnd = random.Random(31)
    grams = lambda t: collections.Counter(g for w in re.findall(r"[^\W\d_]+", t.lower()) for g in [*w, *("_" + w + "_")[:2].split("|"), *(f"_{w}_"[k : k + 2] for k in range(1, len(w) + 1)), *(f"_{w}_"[k : k + 3] for k in range(len(w)))])
    texts = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 300))) for _ in range(40)] + ["", "a", "b b", "x" * 5000]
    samples = {x: "".join(rnd.choice("abcdé "[k : k + 4] + " ") for _ in range(900)) for k, x in enumerate(("l1", "l2", "l3"))}
    profiles = {x: langid.ranked(t, 50).tolist() for x, t in samples.items()}
    names, scores = langid.judge(texts, profiles, 50)
    for text, name, score in zip(texts, names, scores, strict=True):
        mine = langid.ranked(text, 50).tolist()
        assert len(mine) == min(50, len(grams(text)))
        far = {x: sum(abs(p.index(g) - k) if g in p else 50 for k, g in enumerate(mine)) for x, p in profiles.items()}
        if not mine:
            assert (name, score) == ("und", 0.0)
            continue
        assert name == min(sorted(far), key=far.get) and score == pytest.approx(1 - far[name] / (50 * len(mine)))


def test_language_stage_drops_what_no_profile_fits(spark):
    rnd = random.Random(21)
    sounds = {"aa": ("ta", "ko", "mi", "lu"), "bb": ("schu", "rf", "xel", "ont"), "zz": ("gwy", "ddl", "pqe", "yff"), "ru": ("\u0447\u0442", "\u043e\u043b", "\u0438\u0437")}
    text = lambda lang, n=40: " ".join("".join(rnd.choice(sounds[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(("aa", "bb")[i % 2], 5 + i % 60), ("aa", "bb")[i % 2]) for i in range(300)]
    rows += [(i, text("zz"), None) for i in range(400, 410)] + [(i, text("ru"), None) for i in range(410, 415)]
    rows += [(500, text("aa"), None), (501, text("bb", 400), "aa"), (502, "12 !", "aa"), (503, None, "aa"), (504, "Tako", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = by_id(corpus_pipeline.language(spark, df, ""))
    assert got.keys() == {*range(300), 500, 501, 504}
    assert all(got[i].lang == ("aa", "bb")[i % 2] for i in range(300))
    assert (got[500].lang, got[501].lang, got[504].lang) == ("aa", "bb", "bb")
    assert got[500].asDict().keys() == {"doc_id", "text", "lang"} and corpus_pipeline.language(spark, df.limit(0), "").count() == 0


def test_scores_equal_hand_count(spark):
    rows = [(1, "a b a b"), (2, "a b c"), (3, "d"), (4, None), (5, "?!")]
    got = by_id(lmscore.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=2))
    # document 1: words of the others a b c d; bigrams ab bc
    want = [1 / 4, 1 / 1, 0.4 * 1 / 4, 1 / 1]
    assert got[1].score == pytest.approx(np.log(want).mean()) and got[1].n_words == 4
    assert got[3].score == pytest.approx(np.log(0.4 / 8))
    assert (got[4].n_words, got[4].score, got[5].score) == (0, None, None)
    assert lmscore.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    rnd = random.Random(17)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 30))) for _ in range(25)] + [None, "a b c d e f " * 300]
    df = spark.createDataFrame([(i // 2, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, chunk string")
    words = [(t or "").split() for t in texts]
    want = []
    for k, w in enumerate(words):
        counts = collections.Counter(tuple(x[i : i + n]) for j, x in enumerate(words) if j != k for n in range(1, order + 1) for i in range(len(x) - n + 1))
        rest = sum(len(x) for j, x in enumerate(words) if j != k)
        total = 0.0
        for i in range(len(w)):
            factor = 1.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if counts[gram]:
                    total += np.log(factor * counts[gram] / (counts[gram[:-1]] if n > 1 else rest))
                    break
                factor *= 0.4 if n > 1 else 0.4 / (rest + 1)
            else:
                total += np.log(factor)
        want.append((k // 2, len(w), round(total / len(w), 9) if w else None))
    got = [(r.doc_id, r.n_words, None if r.score is None else round(r.score, 9)) for r in lmscore.lm_scores(df, order=order, chunk_chars=200, bucket_ngrams=100).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_scores_of_many_repeated_rows(spark):
    """Equal rows and rows without a doc_id are dealt apart, and each scores against all others."""
    rows = [(None, "one text of a few words")] * 300 + [(5, "one text of a few words")] * 300 + [(6, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lmscore.lm_scores(df, chunk_chars=500).collect()
    assert len(got) == 601 and len({round(r.score, 9) for r in got if r.doc_id != 6}) == 1
    apart = lmscore.lm_scores(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string"), chunk_chars=500).collect()
    assert {round(r.score, 9) for r in apart} == {round(r.score, 9) for r in got}


def test_counts_in_other_documents_equal_brute_force():
    def chunk(texts):
        grams = lmscore.Grams(pa.array(texts), 3)
        h, n = grams.distinct()
        sent = pa.concat_tables([_counts.cells(h, n, 0, 3), _counts.cells(h[::2], 2 * n[::2], 1, 3)])
        back = pa.concat_tables([_counts.add(sent.filter(pa.compute.equal(sent["bucket"], b))) for b in sent["bucket"].unique().to_pylist()])
        return grams, dict(zip(h.tolist(), (n + np.where(np.arange(len(n)) % 2 == 0, 2 * n, 0)).tolist(), strict=True)), back.filter(pa.compute.equal(back["chunk"], 0))

    rnd = random.Random(41)
    for texts in ([], [None, ""], ["one"], [None, "a b", "a b c a b c a", "", "b a b", *(prose(rnd, rnd.randint(0, 90)) for _ in range(30))]):
        grams, total, shared = chunk(texts)
        got, n_words = lmscore._others(grams, shared)
        assert n_words == total[0]
        for x, y in zip(grams.by_order, got, strict=True):
            want = []
            for a, b in itertools.pairwise(grams.rows.tolist()):
                own = collections.Counter(x[a:b].tolist())
                want += [total[h] - own[h] if h else 0 for h in x[a:b].tolist()]
            assert y.tolist() == want


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_do_not_depend_on_chunks(docs, order):
    one = {(r.doc_id, r.n_words): r.score for r in lmscore.lm_scores(docs, order=order).collect()}
    many = {(r.doc_id, r.n_words): r.score for r in lmscore.lm_scores(docs, order=order, chunk_chars=5000, bucket_ngrams=3000).collect()}
    assert one.keys() == many.keys() and all(a == b or a == pytest.approx(b) for a, b in ((one[k], many[k]) for k in one))


def test_fingerprints_with_next_document(docs, corpus, none):
    rows = sorted(((i is not None, i or 0, t or "") for i, t, *_ in corpus))
    got = {(r.doc_id, r.n_chars): r for r in fingerprint.compare_with_next(docs).collect()}
    for k, (real, i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][2]
        m = len(t) // 4
        edited = t[: len(t) - m] + following[:m]
        r = got[i if real else None, len(t)]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (fingerprint.sketches([x])[0] for x in (t, edited, following))
        assert r.fingerprint == a.astype(">u4").tobytes().hex() and r.near_edited == fingerprint.likeness(a, b) and r.near_next == fingerprint.likeness(a, c)
    assert fingerprint.compare_with_next(none).count() == 0
    assert {r.doc_id for r in fingerprint.fingerprints(docs).collect()} == {i for i, *_ in corpus}


M64 = (1 << 64) - 1


def slow_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def slow_phrases(text, levels=3):
    """Locally consistent parsing, symbol by symbol."""
    x = [slow_mix(ord(c) + 1) for c in text]
    for _ in range(levels):
        x = [slow_mix((s + n * 0x9E3779B97F4A7C15) & M64) if n > 1 else s for s, n in ((s, len(list(g))) for s, g in itertools.groupby(x))]
        label = x
        for _ in range(3):
            tossed = []
            for i, v in enumerate(label):
                other = label[i - 1] if i else v ^ 1
                low = ((v ^ other) & -(v ^ other)).bit_length() - 1
                tossed.append(2 * low + (v >> low & 1))
            label = tossed
        starts = [i for i in range(len(x)) if i == 0 or i > 1 and label[i] > label[i - 1] and label[i] >= (label[i + 1] if i + 1 < len(x) else 0)]
        x = [slow_mix((sum(v * int(fingerprint._POW[k & 255]) for k, v in enumerate(x[a:b])) + b - a) & M64) for a, b in itertools.pairwise([*starts, len(x)])]
    return x


def test_parse_equals_brute_force():
    rnd = random.Random(41)
    texts = ["", "a", "ab", "aaaa", "a" * 3000, prose(rnd, 200), "\U0001f600é\n" * 40, *("".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 400))) for _ in range(60))]
    names, rows = fingerprint.phrase_names(texts)
    for t, a, b in zip(texts, rows[:-1], rows[1:], strict=True):
        want = slow_phrases(t) if t else []
        assert names[a:b].tolist() == want
        assert fingerprint.sketches([t])[0].tolist() == sorted({x >> 32 for x in want})[: fingerprint.KEEP]


def test_equal_substrings_share_phrases_at_any_offset():
    rnd = random.Random(1)
    part = prose(rnd, 300)
    a = set(fingerprint.phrase_names([part])[0].tolist())
    for shift in range(1, 9):
        b = set(fingerprint.phrase_names(["q" * shift + " " + part + " tail"])[0].tolist())
        assert len(a & b) >= 0.9 * len(a)


def brute_alignment(item, words):
    h = np.zeros((len(item) + 1, len(words) + 1), int)
    for i, x in enumerate(item, 1):
        for j, y in enumerate(words, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (1 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_smith_waterman_equals_brute_force():
    rnd = np.random.default_rng(1)
    for _ in range(100):
        a, b = rnd.integers(0, 4, rnd.integers(1, 20)), rnd.integers(0, 4, rnd.integers(1, 30))
        assert decontam.smith_waterman(a, b)[0] == brute_alignment(a.tolist(), b.tolist())


def test_leaks_equal_alignment_of_all_pairs(spark):
    """Every pair is found whose alignment reaches the threshold, at its best score, with words replaced, put in and left out."""
    rnd = random.Random(44)
    few = WORDS[:25]
    items = [(i, " ".join(rnd.choice(few) for _ in range(rnd.randint(1, 25)))) for i in range(25)]
    rows = []
    for i in range(40):
        w = [rnd.choice(few) for _ in range(rnd.randint(0, 60))]
        if i % 2:
            part = items[rnd.randrange(25)][1].split()
            for _ in range(rnd.randint(0, 1 + len(part) // 3)):
                at = rnd.randrange(len(part))
                part[at : at + rnd.randint(0, 1)] = [rnd.choice(few)] * rnd.randint(0, 1)
                part = part or ["x"]
            w[10:10] = part
        rows.append((i if i % 5 else None, " ".join(w), "x"))
    rows += [(3, rows[3][1], "x"), (77, " ".join(prose(rnd, 20000).split() + items[4][1].split()), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    tests = spark.createDataFrame([(*x, 5) for x in items], "item_id long, text string, score int")
    want = collections.Counter()
    leaking = set()
    for k, (i, t, _) in enumerate(rows):
        for j, item in items:
            a, b = item.split(), t.split()
            if len(b) > 10000:
                b = b[-len(a) - 200 :]
            score = brute_alignment(a, b)
            if score >= (0.5 * len(a) if len(a) >= 8 else len(a)):
                want[i, j, round(score / len(a), 9)] += 1
                leaking.add(k)
    got = collections.Counter((r.doc_id, r.item_id, round(r.score, 9)) for r in decontam.find_leaks(df, tests, block_words=150).collect())
    long = {x for x in got if x[0] == 77} | {x for x in want if x[0] == 77}
    assert {k: n for k, n in got.items() if k not in long} == {k: n for k, n in want.items() if k not in long}
    assert any(x[:2] == (77, 4) for x in got)
    kept = decontam.drop_leaks(df, tests)
    assert kept.columns == df.columns
    assert sorted(r.text for r in kept.where("doc_id is null or doc_id <> 77").collect()) == sorted(t for k, (i, t, _) in enumerate(rows) if k not in leaking and i != 77)
    assert decontam.drop_leaks(df.limit(0), tests).count() == 0


@pytest.mark.parametrize("common", [False, True])
def test_edits_that_leave_no_three_words_on_end(spark, common):
    """Two words of eight replaced; a word put in after every second one; also where the item's pairs are in all documents."""
    rnd = random.Random(31)
    short, long = [f"s{i}" for i in range(8)], [f"l{i}" for i in range(40)]
    edited = ["x" if i in (2, 5) else w for i, w in enumerate(short)]
    stuffed = [v for i, w in enumerate(long) for v in ([w, f"in{i}"] if i % 2 and i < 39 else [w])]
    rest = " . ".join(" ".join(x[i : i + 2]) for x in (short, long) for i in range(len(x) - 1)) if common else ""
    rows = [(1, " ".join(edited)), (2, f"{prose(rnd, 30)} {' '.join(stuffed)} {prose(rnd, 30)}"), *((i, f"{prose(rnd, 20)} {' q '.join(rest.split(' . '))}") for i in range(3, 30))]
    tests = spark.createDataFrame([(1, " ".join(short)), (2, " ".join(long))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), tests).collect()}
    want = {(d, i): brute_alignment(item, t.lower().split()) / len(item) for d, t in rows for i, item in ((1, short), (2, long))}
    assert got[1, 1] == 0.5 and got[2, 2] == 0.525 and got == {k: v for k, v in want.items() if v >= 0.5}
    with pytest.raises(ValueError):
        decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), tests, threshold=0.1)


def test_leaks_whole_edited_and_none(spark, docs, none):
    rnd = random.Random(8)
    items = [(i, prose(random.Random(1000 + i), 30)) for i in range(5)] + [(90, None), (91, "?"), (92, "kara lonet")]
    edited = items[1][1].split()
    edited[10:12] = ["something", "else", "here"]
    rows = [(1, f"{prose(rnd, 40)} {items[0][1].upper()}! {prose(rnd, 10)}"), (2, f"{prose(rnd, 20)} {' '.join(edited)}"), (3, prose(rnd, 200)), (4, None), (5, ""), (6, "é " + items[2][1]), (7, "kara, lonet")]
    text = dict(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 40):
        got = {(r.doc_id, r.item_id): r for r in decontam.find_leaks(df, tests, block_words=block).collect()}
        assert {k for k in got if k[1] < 90} == {(1, 0), (2, 1), (6, 2)} and (7, 92) in got
        r = got[1, 0]
        assert r.score == 1.0 and text[1][r.start : r.end] == items[0][1].upper()
        assert 0.7 < got[2, 1].score < 1
        assert text[6][got[6, 2].start : got[6, 2].end] == items[2][1]
    assert decontam.find_leaks(none, tests).count() == 0 and decontam.find_leaks(df, tests.limit(0)).count() == 0


@pytest.mark.parametrize(("n_docs", "copies"), [(200, 3), (20, 1), (20, 15)])
def test_edited_item_in_many_documents_is_a_leak(spark, n_docs, copies):
    """Each fifth word replaced: no seed of the rest may be left aside as common, nor in a small table."""
    rnd = random.Random(12)
    words = [f"item{i}" for i in range(30)]
    edited = " ".join(f"edit{i}" if i % 5 == 2 else x for i, x in enumerate(words))
    rows = [(i, f"{prose(rnd, 20)} {edited} {prose(rnd, 20)}" if i < copies else prose(rnd, 60)) for i in range(n_docs)]
    tests = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    got = decontam.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), tests).collect()
    assert sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in got) == [(i, 7, 0.6) for i in range(copies)]


def test_repeats_keep_the_earliest(docs, corpus, none):
    got = by_id(repeats.remove_repeats(docs))
    text = {i: t or "" for i, t, *_ in corpus}
    assert got[200].removed == []
    for i in (201, 202, 203):
        (s, e), = [tuple(x) for x in got[i].removed]
        assert len(text[i][s:e].split()) == 60 and text[i][s:e] in text[200] and got[i].text == text[i][:s] + text[i][e:]
    assert all(got[100 + i].removed for i in range(6)) and all(got[i].text == text[i] for i in (*range(60), 300, 301, 302, 303))
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_within_a_document_and_in_rows_of_one_number_go(spark):
    rnd = random.Random(13)
    line = prose(rnd, 12).capitalize() + ".\n"
    one, two, rest = (prose(rnd, 15).capitalize() + ".\n" for _ in range(3))
    rows = [(1, one + line + two + line + rest + line), (2, line * 1000), (5, one + two), (7, rest.lower() + "q"), (7, rest.lower() + "q"), (None, line + "Zebra"), (None, "Only here"), (8, None)]
    got = collections.defaultdict(list)
    for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        got[r.doc_id].append(re.findall(r"\w+", r.text))
    words = lambda t: re.findall(r"\w+", t)
    assert got[1] == [words(one + line + two + rest)]
    assert got[2] == [[]] and got[5] == [[]] and got[8] == [[]]
    assert sorted(got[7]) == [["q"], ["q"]] or sorted(got[7]) == [[], ["q"]]
    assert sorted(got[None]) == [["Only", "here"], ["Zebra"]]
    alone = spark.createDataFrame([(4, line * 1000)], "doc_id long, text string")
    assert words(repeats.remove_repeats(alone).first().text) == words(line)
    twice = spark.createDataFrame([(4, one + two), (4, one + two), (None, one)], "doc_id long, text string")
    assert sorted((words(r.text) for r in repeats.remove_repeats(twice).collect()), key=len) == [[], [], words(one + two)]
    assert {(r.doc_id, r.keeper) for r in repeats.repeated_spans(twice).collect()} == {(4, 4), (None, 4)}


def test_repeated_lines_go_whole_however_short(spark):
    """The other lines are new in each document, so no run of repeats reaches ten words."""
    rnd = random.Random(14)
    new = lambda: " ".join(f"n{rnd.getrandbits(60)}" for _ in range(6))
    rows, want = [], []
    for i in range(12):
        a, b = new(), new()
        rows.append((i, f"{a}\n\u00bfThe and Été (the).  Home page!\n{b}\nMenu"))
        want.append(rows[0][1] if i == 0 else f"{a}\n{b}\n")
    rows += [(20, "Menu\n" * 50 + "say Menu in a line\n--\n--"), (21, "menu")]
    want += ["say Menu in a line\n--\n--", ""]
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.doc_id)] == want
    for r in got:
        at = [x for s in r.removed for x in s]
        assert at == sorted(at)


def test_url_rules(spark):
    urls = ["http://Net/", "https://a.NET/x", "https://m.example.net/en/1?q#f", "https://example.net/english", "http://b.example.com/de/", "http://example.com/de", "ftp://x.org/fr/2", "http://myexample.com/de/1", "no scheme", None, "http://", "http://x.net?a=/", "http://x.org#/fr/", "http://planet/", "x://a.com:80/b"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    got = {r.page_id: r for r in urlrules.filter_urls(df).collect()}
    host_path = [("net", "/"), ("a.net", "/x"), ("m.example.net", "/en/1"), ("example.net", "/english"), ("b.example.com", "/de/"), ("example.com", "/de"), ("x.org", "/fr/2"), ("myexample.com", "/de/1"), ("", ""), ("", ""), ("", ""), ("x.net", ""), ("x.org", ""), ("planet", "/"), ("a.com:80", "/b")]
    assert [(got[i].host, got[i].path) for i in range(len(urls))] == host_path
    rules = ["net/", "net/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", *[None] * 8]
    assert [got[i].rule for i in range(len(urls))] == rules
    assert all(got[i].verdict == v for i, v in enumerate(["block", "block", "allow", "block", "block"]))
    assert got[8].verdict == got[9].verdict == "allow"
    assert urlrules.filter_urls(df.limit(0)).count() == 0


def test_mined_rules_by_brute_force(spark):
    rows = [(["a", "b"], "block")] * 40 + [(["a", "c"], "allow")] * 40 + [(["c"], "allow")] * 20
    df = spark.createDataFrame([(t, v, str(i)) for i, (t, v) in enumerate(rows)], "tokens array<string>, verdict string, key string")
    got = {(" ".join(r.tokens), r.verdict): r.confidence for r in urlrules.mine(df).collect()}
    assert got == {("b", "block"): 1.0, ("c", "allow"): 1.0}


def slow_tokens(url, host, path):
    query = re.search(r"[?]([^#]*)", url or "")
    out = {"host:" + x for x in host.split(".")} | {"path:" + re.sub("[0-9]+", "#", x) for x in path.lower().split("/")} | {"field:" + x.split("=")[0] for x in (query[1] if query else "").split("&")}
    return sorted(out - {"host:", "path:", "field:"})


def test_url_verdicts_equal_brute_force(spark):
    rnd = random.Random(52)
    hosts = ["a.net", "b.net", "x.example.net", "example.com", "m.example.com", "z.org", "Q.Org", "shop.de", "a.shop.de", "plain.com"]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['de', 'fr', 'en', 'x'])}/{rnd.choice(['buy', 'read', str(rnd.randint(0, 99))])}{rnd.choice(['', '?id=3', '?ad=1&id=2#f'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "http://a.net/" + "y/" * 5000, urls[0], urls[0]]
    df = spark.createDataFrame([(i // 2, u, "t", "g") for i, u in enumerate(urls)], "page_id long, url string, tokens string, given string")
    explicit, parsed = [], []
    for u in urls:
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        explicit.append(max(fits)[1:] if fits else (None, None))
        parsed.append((host, path, slow_tokens(u, host, path)))
    every = [(set(t), v) for (_, _, t), (_, v) in zip(parsed, explicit, strict=True)]
    labelled = [(t, v) for t, v in every if v]
    n, least = len(labelled), 0.05 * len(labelled)
    where = collections.defaultdict(set)
    for i, (t, _) in enumerate(labelled):
        for x in t:
            where[x].add(i)
    pages = collections.Counter(x for t, _ in every for x in t)
    first = {}
    for x in sorted(where, key=lambda x: (pages[x], x)):
        first.setdefault(frozenset(where[x]), x)
    kept = {x for r, x in first.items() if len(r) >= least}
    counts = collections.Counter((c, v) for t, v in labelled for k in range(1, len(t & kept) + 1) for c in itertools.combinations(sorted(t & kept), k))
    sizes = collections.Counter()
    for (c, _), m in counts.items():
        sizes[c] += m
    rules = {(c, v): (m / sizes[c], m / n) for (c, v), m in counts.items() if m >= least and m / sizes[c] >= 0.9}
    rules = {(c, v): x for (c, v), x in rules.items() if not any(v == w and set(d) < set(c) and y[0] >= x[0] for (d, w), y in rules.items())}
    share = collections.Counter(v for _, v in labelled)
    met = {c: collections.Counter(v for t, v in every if set(c) <= t) for c, _ in rules}
    rules = {(c, v): x for (c, v), x in rules.items() if met[c][v] * len(every) >= 1.05 * sum(met[c].values()) * share[v]}
    assert rules
    got = {(r.page_id, r.rule, r.verdict, r.mined_rule) for r in urlrules.filter_urls(df, support=0.05).collect()}
    want = set()
    for i, ((_, _, t), (rule, v)) in enumerate(zip(parsed, explicit, strict=True)):
        best = max(((*x, w, c) for (c, w), x in rules.items() if set(c) <= set(t)), default=None)
        want.add((i // 2, rule, v or (best[2] if best else "allow"), None if v else " ".join(best[3]) if best else ""))
    assert {x[:3] for x in got} == {x[:3] for x in want}
    assert {x for x in got if x[3]} == {x for x in want if x[3]}


def test_long_urls_repeated_in_many_rows_are_mined_in_pieces(spark):
    """Forty path segments in a third of all labelled rows: tokens of the same rows count once, and others are cut into pieces."""
    rnd = random.Random(9)
    long = "http://a.net/" + "/".join(f"seg{chr(97 + i % 26)}{'x' * (i // 26)}" for i in range(40))
    parts = [f"p{chr(97 + i)}" for i in range(12)]
    urls = [long] * 200 + [f"http://b{rnd.choice('cd')}.net/" + "/".join(rnd.sample(parts, 10)) for _ in range(200)] + [f"http://z.org/fr/{rnd.choice('uvw')}" for _ in range(200)] + ["http://a.com/" + long.split("/", 3)[3]]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlrules.filter_urls(df).collect()}
    assert len(got) == len(urls) and got[600].verdict == "block" and got[600].mined_rule
    sizes = urlrules._pieces(spark.createDataFrame([(i, [f"t{j}" for j in range(25) if (i >> j % 5) & 1 or j == i % 25], "block") for i in range(64)], "row long, tokens array<string>, verdict string"), 1).select("items").collect()
    assert max(len(r.items) for r in sizes) <= urlrules.MOST_TOKENS


def test_pages_that_no_rule_decides_are_the_contrast(spark):
    """All labelled pages of a host label are blocked, but they are few of its pages: it decides nothing; what stands on blocked pages alone does."""
    urls = [f"http://example.com/de/win/{i}" for i in range(60)] + [f"http://other.com/en/{i}" for i in range(300)] + [f"http://y.org/fr/{i}" for i in range(40)] + ["http://example.org/de/win/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlrules.filter_urls(df).collect()}
    assert {got[i].verdict for i in range(60, 360)} == {"allow"} and got[400].verdict == "block" and got[400].mined_rule == "host:example"


BASE = [re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute_spans(text):
    out = []
    for k, pattern in enumerate(BASE):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(digits))) % 10 == 0
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(digits) <= 19 and luhn or k == 3 and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_the_plain_expressions():
    rnd = random.Random(4)
    parts = ["a", "b.c", "@", "@x.de", ".", "1", "4111 1111 1111 1111", "10.0.0.1", "300.1.2.3", "+49 (0) 30-12345", " ", "-", "+", "(", ")", "é", "0", "00255", "%", "\n", "٣"]
    for _ in range(6000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(text) == brute_spans(text)
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 200_000, "@a" * 50_000):
        pii.base_spans(text)
    for zeros in (1, 4300, 4301, 50_000):
        text = f"at {'0' * zeros}.1.1.1 and {'0' * zeros}255.0.0.{'0' * zeros} not {'0' * zeros}256.0.0.1"
        assert [text[s:e] for s, _, e in pii.base_spans(text)] == text.replace("not", "").split()[1:4:2]


def people(rnd, n, missed):
    """Documents that name a number twice, the second time whole or (a share of `missed`) without what the pattern needs, beside other numbers; and where the missed ones stand."""
    out = []
    for _ in range(n):
        number = f"{rnd.randint(200, 999)}-{rnd.randint(200, 999)}-{rnd.randint(1000, 9999)}"
        again = number if rnd.random() < missed else f"+1-{number}"
        text = f"{prose(rnd, 8)} call +1-{number} {prose(rnd, 30)} again {again} {prose(rnd, 6)} order {rnd.randint(100, 999)}-{rnd.randint(100, 999)}-{rnd.randint(1000, 9999)} {prose(rnd, 5)}"
        out.append((text, text.rindex(again) if again == number else None))
    return out


def test_field_finds_forms_that_patterns_miss():
    """Recall and precision of added spans on labelled documents, with potentials learned from other documents."""
    rnd = random.Random(6)
    model = pii.train([t for t, _ in people(rnd, 400, 0.1)])
    assert model["skip"][4, 4] > 0.5 and model["skip"][4, 0] < -1
    assert np.allclose(pii.log_odds(np.zeros((6, 6)), np.arange(6)), 0)
    held = people(rnd, 200, 0.5)
    _, added = pii.find_spans([t for t, _ in held], model)
    right = sum(at is not None and any(s <= at < e and k == 3 for s, k, e in x) for (_, at), x in zip(held, added, strict=True))
    assert right >= 0.9 * sum(at is not None for _, at in held)
    assert sum(map(len, added)) <= 1.05 * right


def test_field_finds_secrets_and_handles_odd_rows(spark, none):
    rnd = random.Random(7)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40))
    keys = [key() for _ in range(60)]
    texts = [f'{prose(rnd, 12)} token = "{k}" {prose(rnd, 12)}' for k in keys] + [f"{prose(rnd, 9)} {k} mentioned once more, token = {k}" for k in keys[:20]] + [f"{prose(rnd, 8)} joe{i}@mail.example.com or 10.0.0.{i} {prose(rnd, 5)} room {i}" for i in range(80)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_added int").repartition(3)
    model = pii.fit(df)
    again = pii.fit(df.repartition(5))
    assert all(np.allclose(model[k], again[k]) for k in model)  # whatever the partitions
    new = key()
    text = f"first {new} alone; {prose(rnd, 20)} token = '{new}' and room 7"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "room 7 is free"), (5, "x " * 60_000 + text)]
    odd = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, r.spans, r.n_secret, r.n_added) for r in pii.detect(odd, model).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    at = text.index(new)
    want = f"secret:{at}:{at + 40},secret:{text.rindex(new)}:{text.rindex(new) + 40}"
    assert got[0] == got[1] == (1, want, 2, 2) and got[-1] == (None, want, 2, 2)
    assert got[2:5] == [(2, "", 0, 0), (3, "", 0, 0), (4, "", 0, 0)] and got[5][2] == 2
    clean = pii.redacted(odd, model)
    assert clean.columns == odd.columns
    assert all(new not in (r.text or "") for r in clean.collect()) and clean.where("doc_id = 2 and text is null").count() == 1
    empty = pii.fit(none)
    assert pii.detect(none, empty).count() == 0 and pii.find_spans(["x 1"], empty)[1] == [[]]
    assert by_id(pii.detect(odd.where("doc_id = 3"), model))[3].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_pair_counts_do_not_depend_on_the_texts_together():
    rnd = random.Random(8)
    texts = [t for t, _ in people(rnd, 30, 0.3)]
    every = pii.Candidates(texts, [pii.taught_spans(t) for t in texts])
    parts = [pii.Candidates([t], [pii.taught_spans(t)]) for t in texts]
    for edges in ("chain", "skip"):
        assert np.array_equal(pii.pair_counts(every, getattr(every, edges)), sum(pii.pair_counts(c, getattr(c, edges)) for c in parts))


def test_messages_on_a_loop_come_near_the_true_marginals():
    rnd = np.random.default_rng(4)
    k = len(pii.LABELS)
    c = object.__new__(pii.Candidates)
    c.features, c.seen = rnd.integers(0, pii.BUCKETS, (4, pii.FEATURES)), np.array([0, 0, 0, 2])
    c.chain, c.skip = np.array([[0, 1], [1, 2], [2, 3]]), np.array([[0, 2], [0, 3]])
    pair = [x + x.T for x in rnd.normal(size=(2, k, k)) / 4]
    model = {"weights": rnd.normal(size=(pii.BUCKETS, k)) / 2, "bias": rnd.normal(size=k), "chain": pair[0], "skip": pair[1]}
    node = model["weights"][c.features].sum(1) + model["bias"]
    want = np.zeros((4, k))
    for labels in itertools.product(range(k), repeat=4):
        if labels[3] == 2:
            p = np.exp(sum(node[i, x] for i, x in enumerate(labels[:3])) + sum(pair[0][labels[i], labels[j]] for i, j in c.chain) + sum(pair[1][labels[i], labels[j]] for i, j in c.skip))
            for i, x in enumerate(labels):
                want[i, x] += p
    want /= want.sum(1, keepdims=True)
    got = pii.marginals(c, model, rounds=80)
    assert np.abs(got - want).max() < 0.05 and (got.argmax(1) == want.argmax(1)).all()


def test_message_passing_is_exact_on_a_chain():
    rnd = np.random.default_rng(3)
    k = len(pii.LABELS)
    c = object.__new__(pii.Candidates)
    c.features, c.seen = rnd.integers(0, pii.BUCKETS, (3, pii.FEATURES)), np.zeros(3, int)
    c.chain, c.skip = np.array([[0, 1], [1, 2]]), np.zeros((0, 2), int)
    model = {"weights": rnd.normal(size=(pii.BUCKETS, k)), "bias": rnd.normal(size=k), "chain": rnd.normal(size=(k, k)), "skip": np.zeros((k, k))}
    node = model["weights"][c.features].sum(1) + model["bias"]
    joint = np.exp(node[0][:, None, None] + node[1][None, :, None] + node[2][None, None, :] + model["chain"][:, :, None] + model["chain"][None, :, :])
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]) / joint.sum()
    assert np.allclose(pii.marginals(c, model, rounds=60), want, atol=1e-6)
