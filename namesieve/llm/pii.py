"""Personal data: fixed patterns, and a skip-chain conditional random field that adds to them.

Patterns find e-mail addresses, IP addresses, card and phone numbers; what they
find stays.  The field labels the *candidates* of a text, tokens with a digit or
an `@`, as one of these kinds, as a secret (keys, tokens, passwords), or as O.
Candidates beside each other are linked as a chain, and distant ones by skip
edges where they repeat or resemble each other (the same letters and digits; the
same run of four digits or more; an e-mail's name).  Tokens inside a pattern's
span are observed, and loopy message passing carries their labels along both
kinds of edges, so one entity gets one label throughout the document.  A token
whose label is not O with probability `sure` adds a span; neighbours with one
label join.

All weights are trained here, on whole documents.  Labels to learn from are the
patterns' spans, and values assigned to a name such as `token` or `password`,
wherever these stand in the document; a candidate without a label that repeats or
resembles one with a label teaches nothing, as it may be a form that was missed.
Label pairs on the chain and skip edges are counted over the whole table, in a
distributed sum; their potentials are the log odds of these counts against
independent labels of all candidates, so edges that teach nothing weigh nothing.  Potentials of
nodes are a multinomial logistic regression on shapes and neighbouring words,
fitted on about `sample_nodes` candidates drawn by a hash of their document and
place.  Skip links of a repeated token go to its first and its previous
occurrence, so their number is linear in the text.

Null texts are empty and hold nothing; long texts are read whole, in linear
time; equal probabilities go to the label listed first; repeated rows are judged
alike; extra columns are ignored; an empty table trains a field that adds
nothing and gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import careful, frugal, tidy

#: The kinds in the order of the listing; the last is found by the field alone.
KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["O", *KINDS]
PATTERNS = 4
SAMPLE_NODES, SURE, BUCKETS, ROUNDS, FEATURES = 100_000, 0.5, 2048, 12, 9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
#: Names that a secret is commonly assigned to; their values are labels to learn from.
_ASSIGNED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{0,8}[=:]\s{0,8}[\"']?([A-Za-z0-9+/_-]{16,})")
_VALUE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_LEAD, _TRAIL = ".,;:!?\"'<[{#$%&*|=", ".,;:!?\"'>]}#$%&*|="


def _luhn(digits: str) -> bool:
    odd = [int(x) for x in reversed(digits)]
    return (sum(odd[::2]) + sum(sum(divmod(2 * x, 10)) for x in odd[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, in order; linear in the text."""
    out: list[tuple[int, int, int]] = []
    at, free = text.find("@"), 0
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at) if s < at else None
        if m:
            out.append((s, 0, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(x in "0123456789" for x in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def taught_spans(text: str) -> list[tuple[int, int, int]]:
    """The spans to learn from: the patterns', and assigned secrets wherever they stand in the text."""
    values = {m[1] for m in _ASSIGNED.finditer(text)}
    return sorted(base_spans(text) + [(m.start(), PATTERNS, m.end()) for m in _VALUE.finditer(text) if m[0] in values] if values else base_spans(text))


def _bucket(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % BUCKETS


def _shape(token: str) -> str:
    """The kinds of characters, runs shortened and at most eight of them; mixtures of letters and digits count as one kind."""
    kinds = re.sub(r"[^\W_]+", lambda m: "9" * min(len(m[0]), 9) if m[0].isdigit() else "a" if m[0].isalpha() else "x", token)
    return kinds[:8]


class Candidates:
    """Candidates of several texts as one graph: spans, labels seen, features, chain and skip edges."""

    def __init__(self, texts: list[str], known: list[list[tuple[int, int, int]]]):
        self.doc, self.start, self.end, self.seen = [], [], [], []
        features, chain, skip = [], [], []
        for d, (text, spans) in enumerate(zip(texts, known, strict=True)):
            if not _ANY.search(text):
                continue
            last_end, at = -9, 0
            keys: dict[str, tuple[int, int]] = {}
            word = ["^", "^"]
            for m in _TOKEN.finditer(text):
                raw = m[0]
                before, word = word, [word[1], raw]
                if not _ANY.search(raw):
                    continue
                lead = len(raw) - len(raw.lstrip(_LEAD))
                s, e = m.start() + lead, m.start() + len(raw.rstrip(_TRAIL))
                if e <= s:
                    continue
                node = len(self.start)
                while at < len(spans) and spans[at][2] <= s:
                    at += 1
                self.seen.append(next((k + 1 for a, k, b in spans[at : at + 4] if a < e and s < b), 0))
                self.doc.append(d)
                self.start.append(s)
                self.end.append(e)
                if s - last_end <= 2:
                    chain.append((node - 1, node))
                last_end = e
                token = text[s:e]
                digits, letters = sum(x.isdigit() for x in token), sum(x.isalpha() for x in token)
                told = (f"shape {_shape(token)}", f"digits {min(digits, 20)}", f"letters {min(letters, 20)}", f"size {min(len(token), 64) // 4}", f"at {token.count('@') > 0}", f"dots {min(token.count('.'), 4)}", f"signs {''.join(sorted(set(re.sub(r'[^\W_]', '', token)))[:8])}", f"before {before[1].strip(_LEAD).lower()[-24:]}", f"two before {before[0].strip(_LEAD).lower()[-24:]}")
                features.append([_bucket(x) for x in told])
                plain = re.sub(r"[\W_]", "", token.lower())
                links = {f"={plain}"} | {f"#{x}" for x in re.findall(r"\d{4,}", token)}
                if "@" in token:
                    links.add("=" + re.sub(r"[\W_]", "", token.split("@")[0].lower()))
                for key in links:
                    if len(key) >= 5:
                        first, previous = keys.get(key, (node, node))
                        skip += [(x, node) for x in {first, previous} if x != node]
                        keys[key] = (first, node)
        pairs = lambda x: np.array(sorted(set(x)), np.int64).reshape(-1, 2)
        self.features = np.array(features, np.int64).reshape(-1, FEATURES)
        self.chain, self.skip = pairs(chain), pairs(skip)
        self.seen = np.array(self.seen, np.int64)


def teaching(c: Candidates) -> np.ndarray:
    """Which candidates teach: all but those without a label that repeat or resemble one with a label, as they may be missed forms of it."""
    out = np.ones(len(c.seen), bool)
    for a, b in ((0, 1), (1, 0)):
        out[c.skip[c.seen[c.skip[:, b]] > 0, a]] = False
    return out | (c.seen > 0)


def pair_counts(c: Candidates, edges: np.ndarray) -> np.ndarray:
    """How often each pair of labels stands on an edge between candidates that teach."""
    n, labels, good = len(LABELS), c.seen, teaching(c)
    edges = edges[good[edges[:, 0]] & good[edges[:, 1]]]
    return np.bincount(labels[edges[:, 0]] * n + labels[edges[:, 1]], minlength=n * n).reshape(n, n).astype(np.int64)


def log_odds(counts: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log odds of label pairs on edges against independent labels of all candidates, symmetric; labels: how often each occurs.

    Ten pairs of independent labels are counted beforehand, so edges that were never seen weigh nothing.
    """
    one = (labels + 0.5) / (labels + 0.5).sum()
    both = counts + counts.T + 10 * np.outer(one, one)
    return np.clip(np.log(both / both.sum()) - np.log(np.outer(one, one)), -4, 4)


def _node_weights(features: np.ndarray, labels: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by AdaGrad; features: bucket numbers of each row."""
    n, k = len(labels), len(LABELS)
    weights, bias = np.zeros((BUCKETS, k)), np.zeros(k)
    bias[0] = 2.0
    if not n:
        return weights, bias
    target = np.eye(k)[labels]
    gw, gb = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    for _ in range(rounds):
        z = weights[features].sum(1) + bias
        p = np.exp(z - z.max(1, keepdims=True))
        d = p / p.sum(1, keepdims=True) - target
        g = np.stack([np.bincount(features.ravel(), np.repeat(d[:, c], features.shape[1]), BUCKETS) for c in range(k)], 1) / n + 1e-5 * weights
        gw += g * g
        gb += d.mean(0) ** 2
        weights -= 0.3 * g / np.sqrt(gw)
        bias -= 0.3 * d.mean(0) / np.sqrt(gb)
    return weights, bias


def _model(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, nodes: np.ndarray) -> dict[str, np.ndarray]:
    weights, bias = _node_weights(features, labels)
    return {"weights": weights, "bias": bias, "chain": log_odds(chain, nodes), "skip": log_odds(skip, nodes)}


def train(texts: list[str]) -> dict[str, np.ndarray]:
    """Weights from these texts alone."""
    c = Candidates(texts, [taught_spans(t) for t in texts])
    good = teaching(c)
    return _model(c.features[good], c.seen[good], pair_counts(c, c.chain), pair_counts(c, c.skip), np.bincount(c.seen[good], minlength=len(LABELS)))


def marginals(c: Candidates, model: dict[str, np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of all candidates by loopy sum-product message passing (damped, in logs)."""
    k = len(LABELS)
    node = model["weights"][c.features].sum(1) + model["bias"]
    node = node - np.logaddexp.reduce(node, 1, keepdims=True) if len(node) else node.reshape(0, k)
    fixed = np.where(np.eye(k, dtype=bool)[c.seen], 0.0, -50.0)
    node = np.where((c.seen > 0)[:, None], fixed, node)
    edges = np.concatenate((c.chain, c.skip))
    if not len(edges):
        return np.exp(node)
    pair = np.concatenate((np.repeat(model["chain"][None], len(c.chain), 0), np.repeat(model["skip"][None], len(c.skip), 0)))
    source, to = np.concatenate((edges[:, 0], edges[:, 1])), np.concatenate((edges[:, 1], edges[:, 0]))
    pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
    back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
    m = np.zeros((len(source), k))
    for _ in range(rounds):
        belief = node.copy()
        np.add.at(belief, to, m)
        out = np.logaddexp.reduce((belief[source] - m[back])[:, :, None] + pair, 1)
        m = 0.5 * m + 0.5 * (out - np.logaddexp.reduce(out, 1, keepdims=True))
    belief = node.copy()
    np.add.at(belief, to, m)
    return np.exp(belief - np.logaddexp.reduce(belief, 1, keepdims=True))


def added_spans(texts: list[str], known: list[list[tuple[int, int, int]]], model: dict[str, np.ndarray], sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """What the field adds to the patterns' spans, for each text."""
    c = Candidates(texts, known)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(c.seen):
        return out
    p = marginals(c, model)
    best = p.argmax(1)
    for i in np.flatnonzero((c.seen == 0) & (best > 0) & (p.max(1) >= sure)):
        mine, kind = out[c.doc[i]], int(best[i]) - 1
        if mine and mine[-1][1] == kind and c.start[i] - mine[-1][2] <= 1 and not any(a < c.start[i] and mine[-1][2] <= a for a, _, _ in known[c.doc[i]]):
            mine[-1] = (mine[-1][0], kind, c.end[i])
        else:
            mine.append((c.start[i], kind, c.end[i]))
    return out


def fit(docs: DataFrame, sample_nodes: int = SAMPLE_NODES, id_col: str = "doc_id", text_col: str = "text") -> dict[str, np.ndarray]:
    """Train the field on whole documents; what comes to the driver is sums of labels and label pairs and about `sample_nodes` candidates."""
    careful(docs.sparkSession)
    some = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9@]"))

    def graphs(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(1).to_pylist()
                yield part.column(0).to_pylist(), Candidates(texts, [taught_spans(t) for t in texts])

    def count(batches):
        chain = skip = np.zeros((len(LABELS), len(LABELS)), np.int64)
        nodes = np.zeros(len(LABELS), np.int64)
        for _, c in graphs(batches):
            chain, skip, nodes = chain + pair_counts(c, c.chain), skip + pair_counts(c, c.skip), nodes + np.bincount(c.seen[teaching(c)], minlength=len(LABELS))
        values = np.concatenate((chain.ravel(), skip.ravel(), nodes))
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(values), dtype=np.int32)), "n": pa.array(values)})

    sums = {r.at: r.n for r in some.mapInArrow(frugal(count), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}
    cells = len(LABELS) ** 2
    chain, skip = (np.array([sums.get(a + i, 0) for i in range(cells)]).reshape(len(LABELS), -1) for a in (0, cells))
    nodes = np.array([sums.get(2 * cells + i, 0) for i in range(len(LABELS))])
    limit = int(min(1.0, sample_nodes / max(nodes.sum(), 1)) * 2**32)

    def draw(batches):
        for ids, c in graphs(batches):
            place = np.array([ids[d] or 0 for d in c.doc], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array(c.start, np.uint64)
            place ^= place >> np.uint64(29)
            keep = np.flatnonzero(teaching(c) & ((place * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) < np.uint64(limit)))
            yield pa.RecordBatch.from_pydict({"f": pa.array([c.features[i].tolist() for i in keep], pa.list_(pa.int32())), "y": pa.array(c.seen[keep].astype(np.int32))})

    drawn = some.mapInArrow(frugal(draw), "f array<int>, y int").groupBy("f", "y").agg(F.count("*").alias("n"))
    rows = sorted((r.f, r.y, r.n) for r in drawn.collect())  # sample_nodes rows at most, in one order whatever the partitions
    features = np.array([f for f, _, n in rows for _ in range(n)], np.int64).reshape(-1, FEATURES)
    return _model(features, np.array([y for _, y, n in rows for _ in range(n)], np.int64), chain, skip, nodes)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long"


def find_spans(texts: list[str], model: dict[str, np.ndarray], sure: float = SURE) -> tuple[list[list], list[list]]:
    """(patterns' spans, added spans) of each text."""
    known = [base_spans(t) if _ANY.search(t) else [] for t in texts]
    return known, added_spans(texts, known, model, sure)


def detect(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", sure: float = SURE) -> DataFrame:
    """Counts and spans of every document, in one pass without a shuffle; n_added and n_secret count what the field adds."""
    careful(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                known, added = find_spans([t or "" for t in part.column(1).to_pylist()], model, sure)
                counts = [[sum(k == j for _, k, _ in s) for s in known] for j in range(PATTERNS)]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column(0)}
                    | {f"n_{kind}": pa.array(counts[j], pa.int64()) for j, kind in enumerate(KINDS[:PATTERNS])}
                    | {"base_sha256": pa.array([hashlib.sha256(written_spans(s).encode()).hexdigest() for s in known]), "spans": pa.array([written_spans(s + x) for s, x in zip(known, added, strict=True)]), "n_added": pa.array([len(x) for x in added], pa.int64()), "n_secret": pa.array([sum(k == PATTERNS for _, k, _ in x) for x in added], pa.int64())}
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(frugal(run), _SCHEMA)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans, the first covers all."""
    out, at = [], 0
    for s, k, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text", sure: float = SURE) -> DataFrame:
    """The same columns, with personal data in the text replaced; a null text stays null."""
    careful(docs.sparkSession)

    @F.pandas_udf("string")
    def run(texts: "pd.Series") -> "pd.Series":
        tidy()
        given = [t or "" for t in texts.tolist()]
        known, added = find_spans(given, model, sure)
        return pd.Series([redact(t, a + b) for t, a, b in zip(given, known, added, strict=True)], dtype=object)

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), run(F.coalesce(F.col(text_col), F.lit("")))))


import pandas as pd  # noqa: E402
