"""A corpus pipeline: each stage is a written table that the next one reads.

For every stage: columns of other names pass through, and may have any name that
a stage uses inside; very long texts are read whole; rows that share a doc_id, or
have none, are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesieve.llm import decontam, langid, neardup, packing, pii
from namesieve.llm._spark import free, written
from namesieve.llm.queries import tokenizer_path


def _as_documents(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are near enough to a learned language; lang becomes what language ID says where the source names none or is clearly contradicted.

    Texts that are null or hold no letter go; equal distances go to the language listed first; repeated rows are judged alike.
    """
    profiles = langid.fit(docs.select("doc_id", "text", "lang"), ~langid.held_out())
    found, score, size, lead = (free(c, docs.columns) for c in ("found", "score", "size", "lead"))
    named = written(langid.predict(docs, profiles, lang=found, score=score, size=size, lead=lead))  # judged once, for the limits and the choice
    limits = langid.limits(named, ~langid.held_out(), "lang", found, score)
    kept = named.where(langid.placed(limits, found, score, size))
    clear = F.col(lead) > langid.spread(size)  # a label of another language fits no better than the next one
    return _as_documents(kept.withColumn("lang", F.when(clear | F.col("lang").isNull(), F.col(found)).otherwise(F.col("lang"))), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one of the least doc_id, those without one last; null texts and texts without words are classes of their own; of repeated rows one stays."""
    return _as_documents(neardup.keep_first(docs), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none, and repeated rows are judged alike."""
    return _as_documents(decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text, and a null text stays null; of overlapping spans the first covers all."""
    clean = pii.redacted(docs, pii.fit(docs.select("doc_id", "text")))
    return _as_documents(clean.withColumn("n_chars", F.length("text").cast("long")), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; a null text is its end id alone, and of equal lengths the order of ranks decides."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), size=1024, end_id=2)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]

#: Tokenizers and sampling are beyond SQL; tests/llm hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
