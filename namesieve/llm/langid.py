"""Language identification by rank-order profiles.

A text's letter n-grams of one to three letters (small letters, words padded by
a boundary, none across words) are ranked by frequency; a language's profile
ranks those of its training texts.  The distance of a text to a language is the
sum over the text's most frequent n-grams of how far each is out of place, and
the full length of a profile for one that the language lacks.  The nearest
language wins; ties go to the language that sorts first.

Profiles are fitted on a bounded sample (`sample_docs` documents of each
language, about, drawn by a hash of doc_id); their size is languages x
`profile`, whatever the corpus, and is checked before it goes to the executors.
Prediction is one pass without a shuffle over whole texts.

`und` and score 0: null text, a text without a letter, or no training text at
all.  Score: 1 less the distance as a share of the greatest possible one.
`placed` rejects a text whose score is below what the training texts of its
language reach, less the spread that so few n-grams leave.
Null languages teach nothing, repeated rows are judged alike, extra columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import careful, free, frugal, tidy

PROFILE, SAMPLE_DOCS, MOST_LANGS = 400, 4000, 5000
LOWEST, SPREAD = 0.001, 1.2  # share of training texts below the limit; three times the deviation of one n-gram's part in a score


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> np.ndarray:
    """The text's n-grams, each as a number: 21 bits for a letter, 0 for a word's boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    c = np.concatenate(([0], np.where(letter, points, 0)[keep], [0])).astype(np.int64)
    if c.max() == 0:
        return np.zeros(0, np.int64)
    one, two = c[c > 0], c[:-1] << 21 | c[1:]
    two = two[two > 0]
    three = (c[:-2] << 42 | c[1:-1] << 21 | c[2:])[c[1:-1] > 0]
    return np.concatenate((one, two + (1 << 62), three))


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts; bigrams are told from trigrams without a first letter by bit 62 of the number, which no trigram of letters below 2^20 has."""
    return np.unique(ngrams(text), return_counts=True)


def ranked(text: str, profile: int = PROFILE) -> np.ndarray:
    """The text's most frequent n-grams, ties by number."""
    grams, counts = _counted(text)
    if len(grams) > profile:
        least = np.partition(counts, len(counts) - profile)[len(counts) - profile]
        some = counts >= least
        grams, counts = grams[some], counts[some]
    return grams[np.argsort(-counts, kind="stable")][:profile]


def fit(docs: DataFrame, training: Column, profile: int = PROFILE, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Profiles by language from the documents that `training` selects."""
    careful(docs.sparkSession)
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: profiles are meant for the driver and every executor")
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample_docs / n))))
    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                part = batch.slice(a, 250)
                by: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by.setdefault(lang, []).append(ngrams(text))
                for lang, grams in by.items():
                    g, n = np.unique(np.concatenate(grams), return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(g), pa.string()), "gram": pa.array(g), "n": pa.array(n)})

    counts = sample.mapInArrow(frugal(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").collect():  # at most languages x profile rows
        out.setdefault(r.lang, []).append(r.gram)
    return out


def judge(texts: list[str | None], profiles: dict[str, list[int]], profile: int = PROFILE) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    return _judged(texts, profiles, profile)[:2]


def _judged(texts: list[str | None], profiles: dict[str, list[int]], profile: int) -> tuple[list[str], list[float], list[int], list[float]]:
    """Language, score, number of n-grams, and lead in score on the next language of each text."""
    langs = sorted(profiles)
    every = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(profiles[x], np.int64) for x in langs)]))
    place = np.full((len(langs), len(every) + 1), -1, np.int32)
    for k, lang in enumerate(langs):
        place[k, np.searchsorted(every, profiles[lang])] = np.arange(len(profiles[lang]))
    names, scores, sizes, leads = [], [], [], []
    for text in texts:
        grams = ranked(text or "", profile)
        sizes.append(len(grams))
        if not len(grams) or not langs:
            names.append("und")
            scores.append(0.0)
            leads.append(0.0)
            continue
        at = np.minimum(np.searchsorted(every, grams), max(len(every) - 1, 0))
        at = np.where(every[at] == grams, at, len(every))
        ranks = place[:, at]
        out = np.where(ranks < 0, profile, np.abs(ranks - np.arange(len(grams), dtype=np.int32))).sum(1)
        best = int(out.argmin())
        names.append(langs[best])
        scores.append(1.0 - float(out[best]) / (profile * len(grams)))
        leads.append(float(min([*np.delete(out, best), profile * len(grams)]) - out[best]) / (profile * len(grams)))
    return names, scores, sizes, leads


def predict(docs: DataFrame, profiles: dict[str, list[int]], profile: int = PROFILE, text_col: str = "text", lang: str = "lang_pred", score: str = "score", size: str | None = None, lead: str = "lead") -> DataFrame:
    """All columns of docs, with the language and the score of each text, and, if `size` names a column, by how many n-grams it was judged and its lead on the next language; they take the place of columns of their names."""
    careful(docs.sparkSession)
    added = [lang, score] + [size, lead] * bool(size)

    @F.pandas_udf(", ".join(f"`{c}` {kind}" for c, kind in zip(added, ("string", "double", "long", "double"), strict=False)))
    def run(texts: "pd.Series") -> "pd.DataFrame":
        tidy()
        found = _judged(texts.tolist(), profiles, profile)
        return pd.DataFrame(dict(zip(added, found, strict=False)))

    # a filter on what it returns would otherwise be pushed below it, and judge every text again in a second worker
    run = run.asNondeterministic()
    taken = [c for c in docs.columns if c.lower() not in {x.lower() for x in added}]
    both = free("judged", taken)
    judged = docs.select(*taken, run(F.coalesce(F.col(text_col), F.lit(""))).alias(both))
    return judged.select(*taken, *(F.col(both)[c].alias(c) for c in added))


def limits(named: DataFrame, training: Column, lang_col: str, lang: str, score: str, lowest: float = LOWEST) -> dict[str, float]:
    """By language, the score that all but `lowest` of its training texts reach; named: what `predict` gave."""
    known = named.where(training & (F.col(lang_col) == F.col(lang)))
    return {r.lang: r.least for r in known.groupBy(F.col(lang).alias("lang")).agg(F.percentile_approx(score, lowest, 10000).alias("least")).collect()}


def spread(size: str) -> Column:
    """How far chance may move the score of a text of so many n-grams."""
    return F.lit(SPREAD) / F.sqrt(F.greatest(F.col(size), F.lit(1)))


def placed(limit: dict[str, float], lang: str, score: str, size: str) -> Column:
    """Whether a text is near enough to its nearest language; one that shares no n-gram with the profiles never is."""
    least = F.lit(0.0)
    if limit:
        least = F.coalesce(F.create_map(*(F.lit(x) for pair in sorted(limit.items()) for x in pair))[F.col(lang)], least)
    return (F.col(lang) != "und") & (F.col(score) > 0) & (F.col(score) >= least - spread(size))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


import pandas as pd  # noqa: E402
