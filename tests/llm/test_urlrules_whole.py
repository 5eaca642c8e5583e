"""Rules are mined from whole rows, however many tokens they have."""

import collections
import itertools
import random

from namesieve.llm import urlrules


def brute(rows, support, confidence):
    """Every rule that no shorter one makes superfluous, over tokens that stand in different rows."""
    where = collections.defaultdict(set)
    for i, (t, _) in enumerate(rows):
        for x in t:
            where[x].add(i)
    first = {}
    for x in sorted(where):
        first.setdefault(frozenset(where[x]), x)
    kept = {x for r, x in first.items() if len(r) >= support * len(rows)}
    counts = collections.Counter((c, v) for t, v in rows for k in range(1, len(kept) + 1) for c in itertools.combinations(sorted(set(t) & kept), k))
    sizes = collections.Counter()
    for (c, _), m in counts.items():
        sizes[c] += m
    rules = {(c, v): m / sizes[c] for (c, v), m in counts.items() if m >= support * len(rows) and m / sizes[c] >= confidence}
    return {x: y for x, y in rules.items() if not any(x[1] == w and set(d) < set(x[0]) and z >= y for (d, w), z in rules.items())}


def test_tokens_far_apart_in_a_long_row_make_a_rule(spark):
    """Blocked where t00 and t11 meet, which no piece of eight tokens held together."""
    rnd = random.Random(4)
    rows = []
    for _ in range(300):
        t = [f"t{i:02}" for i in range(12) if rnd.random() < (0.5 if i in (0, 11) else 0.9)]
        rows.append((t, "block" if {"t00", "t11"} <= set(t) else "allow"))
    df = spark.createDataFrame([(t, v, str(i)) for i, (t, v) in enumerate(rows)], "tokens array<string>, verdict string, key string")
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in urlrules.mine(df, support=0.05).collect()}
    assert got == brute(rows, 0.05, 0.9) and (("t00", "t11"), "block") in got


def test_rules_with_exceptions_equal_brute_force(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(400):
        t = sorted(rnd.sample("abcdefghijk", rnd.randint(0, 10)))
        rows.append((t, "block" if {"a", "k"} <= set(t) and rnd.random() < 0.93 or rnd.random() < 0.1 else "allow"))
    df = spark.createDataFrame([(t, v, str(i)) for i, (t, v) in enumerate(rows)], "tokens array<string>, verdict string, key string")
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in urlrules.mine(df, support=0.05, confidence=0.8).collect()}
    assert got == brute(rows, 0.05, 0.8) and max(len(c) for c, _ in got) > 2
