"""How filters interact: every order of them is replayed over every document's flags.

A document is one row of flags (one bit a filter that it fails).  These rows
are crossed with a table of all orders (120 for five filters: a size that no
corpus changes, so it is broadcast), each pair gets the step at which the
document goes, the steps are exploded, and conditional counts by part, order
and step are combined in each task before they are shuffled.

Defined results: a null text counts as empty; a null part as the empty string;
documents without a doc_id have no earlier copy, and no labels; rows that
share a doc_id are rows of their own, and none of them is earlier than the
other; labels of one doc_id are true where any of its rows is.  Very long
texts are taken whole, ties do not arise, an empty table gives no rows, and
columns of any other name are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written

#: Orders are n!, so that more filters would no longer be a small table.
MOST_FILTERS = 6


def text_failures(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, Column]]:
    """docs with helper columns, and the conditions A to D over them: few words, few distinct words, many capitals, any of #$%&*|."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = docs.withColumn("_words", F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != ""))
    sizes = words.withColumns({"_n": F.size("_words"), "_distinct": F.size(F.array_distinct("_words"))}).drop("_words")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return sizes, {
        "A": F.col("_n") < 200,
        "B": 100 * F.col("_distinct") < 50 * F.col("_n"),
        "C": 100 * capitals > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, failed, good, toxic) for each row of docs; bit i of failed is the i-th of the filters A to E.

    The text is read once; what is left is a written table of one short row a
    document.  E needs the least doc_id of each text.  Those are joined back
    by doc_id and text, not by text, so that a text with a third of all rows
    makes no hot key.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    sized, fails = text_failures(base)
    failed = sum((fails[f].cast("int") * (1 << i) for i, f in enumerate("ABCD")), F.lit(0))
    rows = written(sized.select("doc_id", "part", failed.alias("failed"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest")))
    known = rows.where("doc_id IS NOT NULL")
    first = known.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    joined = known.join(marks, "doc_id", "left").join(first, ["doc_id", "digest"], "left")
    judged = joined.select("part", F.when(F.col("first"), F.col("failed")).otherwise(F.col("failed") + 16).alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    return judged.union(rows.where("doc_id IS NULL").select("part", "failed", F.lit(False), F.lit(False)))


def audit(flags: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """What each filter does at each step of each order of the filters, for each part.

    flags: part, failed (bit i: fails filters[i]), good, toxic.  Counts are
    documents of the part: kept after the step, removed at it, redundant
    (failing its filter, but gone before), unique_fails (failing its filter
    alone), good_lost and toxic_lost among the removed; shapley is what the
    filter removes, summed over all orders.
    """
    if not 1 <= len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters, each once")
    spark, steps = flags.sparkSession, range(len(filters))
    bits = [f"bit{i}" for i in steps]
    rows = [(k, "".join(filters[i] for i in p), *(1 << i for i in p)) for k, p in enumerate(permutations(steps))]
    orders = spark.createDataFrame(rows, ", ".join(["n int", "filter_order string", *(f"{b} int" for b in bits)]))
    failed = F.col("failed")
    gone = F.lit(len(filters) + 1)
    for i in reversed(steps):
        gone = F.when(failed.bitwiseAND(F.col(bits[i])) != 0, i + 1).otherwise(gone)
    crossed = flags.crossJoin(F.broadcast(orders.drop("filter_order"))).withColumn("gone", gone)
    each = crossed.select("part", "n", "failed", "good", "toxic", "gone", F.posexplode(F.array(*bits)).alias("at", "bit"))
    step = F.col("at") + 1
    fails, here = failed.bitwiseAND(F.col("bit")) != 0, F.col("gone") == step
    counts = each.groupBy("part", "n", step.cast("int").alias("step")).agg(
        F.count_if(F.col("gone") > step).alias("kept"),
        F.count_if(here).alias("removed"),
        F.count_if(fails & (F.col("gone") < step)).alias("redundant"),
        F.count_if(failed == F.col("bit")).alias("unique_fails"),
        F.count_if(here & F.col("good")).alias("good_lost"),
        F.count_if(here & F.col("toxic")).alias("toxic_lost"),
    )
    named = counts.join(F.broadcast(orders.select("n", "filter_order")), "n").withColumn("_filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shapley = F.sum("removed").over(Window.partitionBy("part", "_filter"))
    return named.withColumn("shapley", shapley).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
