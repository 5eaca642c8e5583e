"""SimHash fingerprints and links against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from namesieve.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(codes, most):
    """The least position that a chain of links reaches."""
    codes = np.asarray(codes, np.uint64)
    least = np.arange(len(codes))
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= most
    while True:
        new = np.array([least[near[i]].min() for i in range(len(codes))])
        if (new == least).all():
            return least.tolist()
        least = new


def near_codes(rnd, n=3000):
    """Random codes, chains of edits and a dense cluster: 1 to 3 bits from one of the former."""
    out = [rnd.getrandbits(64) for _ in range(n // 3)]
    while len(out) < 2 * n // 3:
        x = rnd.choice(out)
        for b in rnd.sample(range(64), rnd.randint(1, 4)):
            x ^= 1 << b
        out.append(x)
    centre = rnd.getrandbits(64)
    while len(out) < n - 4:
        x = centre
        for b in rnd.sample(range(64), rnd.randint(0, 3)):
            x ^= 1 << b
        out.append(x)
    return list(dict.fromkeys([*out, 0, 1, (1 << 64) - 1, 1 << 63]))


TEXTS = [None, "", " \t\n", "one", "One TWO", "a b c", "A  b\x0bC", "a b c d", "É é\xa0x İ ß", "x " * 5000, *(" ".join(random.Random(i).choices("abcdef", k=i)) for i in range(40)), "ends with space ", "\nstarts", "z" * 3000 + " y", "𝄞 music 𝄞"]


def test_fingerprints_equal_the_plain_definition():
    assert simhash.simhash(pa.array(TEXTS, pa.string())).tolist() == [plain(t) for t in TEXTS]
    assert simhash.simhash(pa.array(TEXTS, pa.string()).slice(5, 20)).tolist() == [plain(t) for t in TEXTS[5:25]]
    assert simhash.simhash(pa.array([], pa.string())).tolist() == []


def test_pieces_of_one_long_text_add_up():
    text = " ".join(random.Random(3).choices([f"w{i}" for i in range(50)], k=2000))
    got = list(simhash.shingle_hashes(pa.array(["a b c", text, "d"]), piece=97))
    assert max(len(r) for r, _ in got) == 97 and sum(len(r) for r, _ in got) == 1 + 1998 + 1


def test_gray_rank_orders_codes_so_that_neighbours_differ_by_a_bit():
    codes = np.arange(1 << 12, dtype=np.uint64)
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all() and len(set(simhash.gray_rank(codes).tolist())) == 1 << 12


@pytest.mark.parametrize("most", [0, 1, 2, 5])
def test_search_finds_all_and_prunes_groups(most, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 2000)
    codes = np.array(near_codes(random.Random(most)), np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    index = simhash.GrayIndex(codes)
    asked = codes[::7]
    got = sorted((int(a), int(b)) for q, leaf in index.search(asked, most) for a, b in zip(q, leaf))
    want = np.argwhere(np.bitwise_count(asked[:, None] ^ codes[None]) <= most)
    assert got == [tuple(x) for x in want.tolist()]
    value, mask = index.root
    assert all(int(c) & mask == value for c in codes)


def test_no_bit_is_held_twice_on_the_way_down():
    codes = np.array(sorted(random.Random(9).sample(range(1 << 20), 5000)), np.uint64)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    levels = simhash.GrayIndex(codes).levels
    held = np.zeros(1, np.uint64)
    for value, mask in reversed(levels):
        held = np.repeat(held, simhash.FAN)[: len(mask)] if len(mask) > 1 else held
        assert not (held & mask).any()
        held = held | mask
    assert (held == ~np.uint64(0)).all()


@pytest.mark.parametrize("block", [64, 4096])
def test_links_join_what_brute_force_joins(spark, block):
    codes = near_codes(random.Random(11))
    signed = np.array(codes, np.uint64).view(np.int64).tolist()
    rank = (simhash.gray_rank(np.array(codes, np.uint64)) ^ np.uint64(1 << 63)).view(np.int64).tolist()
    found = simhash.links(spark.createDataFrame(list(zip(signed, rank)), "code long, rank long"), 2, block).collect()
    assert all((a ^ b) % (1 << 64) for a, b in found)
    at, least = {c: i for i, c in enumerate(signed)}, list(range(len(codes)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in found:
        x, y = sorted((root(at[a]), root(at[b])))
        least[y] = x
    assert [root(i) for i in range(len(codes))] == classes(codes, 2)
    assert len(found) < 40 * len(codes)  # forests, not all links of the dense cluster


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 400))) for _ in range(60)]
    for t in texts[:40]:  # long texts with one word more: a few bits
        texts += [t, t + " w1", t.upper(), t + " w1 w2"]
    texts += [None, "", " ", "x"] + ["a copy of many"] * 700
    ids = rnd.sample(range(10_000), len(texts))
    ids[3] = ids[4] = 5
    ids[50] = None
    rows = [(t, i, "s", 0) for t, i in zip(texts, ids)] + [(None, None, None, 1)]
    docs = spark.createDataFrame(rows, "text string, doc_id long, code string, rank int").repartition(5)
    codes = [plain(t) for t, *_ in rows]
    each = classes(codes, 2)
    least = {}
    for (_, i, *_), c in zip(rows, each):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, f"{x:016x}", least.get(c)) for (_, i, *_), x, c in zip(rows, codes, each)), key=str)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert len(set(each)) < len(set(codes))
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
