"""The audit of filter orders against plain counting, with odd data."""

import random
import re
from itertools import permutations

import pytest

from namesieve.llm import filteraudit

DOCS = "doc_id long, text string, source string, part string, failed int, _n string"
LABELS = "doc_id long, quality int, toxic int"


def run(spark, docs, labels):
    d = spark.createDataFrame([(i, t, s, "p", 9, "x") for i, t, s in docs], DOCS).repartition(3)
    got = filteraudit.audit(filteraudit.flagged(d, spark.createDataFrame(labels, LABELS))).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got}
    assert len(out) == len(got)
    return out


def failing(docs, i):
    doc_id, text, _ = docs[i]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    earlier = doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in docs)
    checks = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), earlier)
    return {f for f, x in zip("ABCDE", checks) if x}


def brute(docs, labels):
    fails = [failing(docs, i) for i in range(len(docs))]
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    out, shapley = {}, {}
    for part in {s or "" for _, _, s in docs}:
        rows = [(d, f) for (d, _, s), f in zip(docs, fails) if (s or "") == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                here = [d for d, x in rows if f in x and not x & set(order[: step - 1])]
                kept = sum(not x & set(order[:step]) for _, x in rows)
                redundant = sum(f in x and bool(x & set(order[: step - 1])) for _, x in rows)
                out[part, order, step] = (kept, len(here), redundant, sum(x == {f} for _, x in rows), sum(d in good for d in here), sum(d in toxic for d in here))
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        some = rnd.choices(words[: rnd.choice((60, 400))], k=rnd.choice((150, 199, 200, 201, 260)))
        if rnd.random() < 0.3:
            some[3] = rnd.choice("#$%&*|")
        if rnd.random() < 0.4:
            some = [w.upper() if rnd.random() < 0.1 else w for w in some]
        texts.append(rnd.choice((" ", "\n", "\x0b\t ", "\xa0 ")).join(some))
    ids = rnd.sample(range(1000), 90)
    docs = [(i, rnd.choice(texts), rnd.choice(("a", "b", "", None))) for i in ids]
    docs += [(2000, None, "a"), (2001, "", "a"), (2002, "  \t", None), (2003, "É" * 50 + "AB", "b"), (2004, "é" * 98 + "AB", "b")]
    docs += [(None, texts[0], "a"), (None, texts[0], "a"), (7000, texts[1], "a"), (7000, texts[1], "a"), (7000, texts[2], "b")]
    docs += [(8000, " ".join(words * 700), "a")]
    labels = [(i, rnd.randint(0, 1), rnd.randint(0, 1)) for i in ids[:60]] + [(ids[0], 1, 0), (7000, 1, None), (None, 1, 1), (99999, 1, 1)]
    return docs, labels


def test_audit_equals_counting(spark):
    docs, labels = corpus()
    assert run(spark, docs, labels) == brute(docs, labels)


def test_a_text_with_most_of_the_rows_and_no_rows(spark):
    docs = [(i, "the same text", "s") for i in range(3000)] + [(5000 + i, f"text {i}", None) for i in range(50)]
    got = run(spark, docs, [])
    assert got["s", "EABCD", 1][:2] == (1, 2999) and got["", "EABCD", 1][:2] == (50, 0)
    assert run(spark, [], []) == {}


def test_other_filters_and_limits(spark):
    flags = spark.createDataFrame([("p", 0b01, True, False), ("p", 0b11, False, True), ("p", 0, True, True)], "part string, failed int, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in filteraudit.audit(flags, "XY").collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 1, 1, 3), ("XY", 2): (1, 0, 1, 0, 0, 0, 1), ("YX", 1): (2, 1, 0, 0, 0, 1, 1), ("YX", 2): (1, 1, 1, 1, 1, 0, 3)}
    for wrong in ("", "ABCDEFG", "AA"):
        with pytest.raises(ValueError):
            filteraudit.audit(flags, wrong)
