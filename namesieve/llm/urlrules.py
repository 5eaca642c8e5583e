"""Association-rule URL filter, on DataFrame functions alone.

Explicit host/path rules label the URLs they decide.  Frequent combinations of
URL tokens are counted together with that label, level by level; rules that end in
a label and pass the thresholds for support and confidence, and that no shorter
rule makes superfluous, are candidates.  The pages that no explicit rule decides
are their contrast: a rule must be met by pages of its verdict more often than
all pages are of that verdict (lift, counted over every page), so a token that
is only labelled because a rule happens to reach a few of its pages decides
nothing.  Matching is an inverted index: distinct token sets are joined to the
rules token by token, and a rule fits where all its tokens were met.  URLs that
no rule fits are allowed.

Mining takes all labelled rows, whole: tokens that are too rare for any rule go
first, tokens that stand in the very same labelled rows count as one (the least),
and a combination grows only while a longer one could make a better rule (see
_levels), so no rule is lost and no row is cut, however long its URL is.

Every distinct token set is judged once (numbers count as one token), so hot
hosts collapse before the shuffle.  A null url or one without `://` has an
empty host and path and no tokens: it is allowed.  Very long URLs are read
whole.  Of rules that fit alike, the greater in confidence, support, verdict and
tokens decides, in this order.  Repeated pages are judged alike, extra columns
are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import written

#: (host, path, verdict): fixed values.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MOST_TOKENS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def decided(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: host labels, path segments (numbers alike), names of query fields."""
    def tagged(tag, parts):
        return F.transform(parts, lambda x: F.concat(F.lit(tag), x))

    segments = F.transform(F.split(F.lower(path), "/"), lambda x: F.regexp_replace(x, "[0-9]+", "#"))
    fields = F.transform(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), "[?]([^#]*)", 1), "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))
    every = F.concat(tagged("host:", F.split(host, "[.]")), tagged("path:", segments), tagged("field:", fields))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: ~x.isin("host:", "path:", "field:"))))


def _kept(labelled: DataFrame, least: float, pages: DataFrame | None = None) -> DataFrame:
    """(row, verdict, tokens, and w where given) of labelled rows (row, tokens, verdict, w: how often it occurs): what is left of their tokens; pages: (token, pages) over all pages."""
    w = F.col("w") if "w" in labelled.columns else F.lit(1)
    each = labelled.select("row", w.alias("w"), F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.sum("w").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y")).where(F.col("n") >= least)
    known = often.withColumn("pages", F.lit(0)) if pages is None else often.join(pages, "token", "left")
    one = known.groupBy("n", "x", "y").agg(F.min_by("token", F.struct("pages", "token")).alias("token")).select("token")  # equal rows: one token stands for all
    kept = each.join(one, "token").groupBy("row").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    return kept.join(labelled.drop("tokens"), "row")


def _pieces(labelled: DataFrame, least: float, pages: DataFrame | None = None) -> DataFrame:
    """(verdict, items): the tokens that _kept leaves, in pieces of MOST_TOKENS, to look at; nothing is mined from them, as they part combinations."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("tokens") - 1) / MOST_TOKENS).cast("int")), lambda i: F.slice("tokens", i * MOST_TOKENS + 1, F.lit(MOST_TOKENS)))
    return _kept(labelled, least, pages).select("verdict", F.explode(cut).alias("items"))


def _levels(rows: DataFrame, least: float, confidence: float) -> DataFrame:
    """(tokens, verdict, m, confidence) of every rule that no shorter one makes superfluous, from rows (row, tokens, verdict, w); m: labelled rows of the verdict that hold all tokens.

    A level holds the combinations of k tokens, and is made of the one before.
    A combination goes on only where a longer rule could still be better: it
    stands in enough rows of one verdict, in fewer rows than each of its parts
    (else that part's rule is as good), and in rows of more than one verdict
    (else its own is as good).  All three hold for every part of a combination
    that they hold for, so no rule is lost, however long rows are.
    """
    each = written(rows.select("row", "verdict", "w", F.explode("tokens").alias("last")))
    hold, before, found, share = each.withColumn("tokens", F.array("last")), None, None, F.col("m") / F.col("n")
    passes, every = (F.col("m") >= least) & (share >= confidence), Window.partitionBy("tokens")
    for k in count(1):
        now = hold.groupBy("tokens", "verdict").agg(F.sum("w").alias("m"))
        now = now.withColumns({"n": F.sum("m").over(every), "top": F.max("m").over(every)}).where(F.col("top") >= least)
        if before is None:
            now = now.withColumn("best", F.lit(0.0))
        else:
            parts = now.withColumn("part", F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))))
            met = parts.join(before, ["part", "verdict"]).groupBy("tokens", "verdict", "m", "n", "top")
            now = met.agg(F.count("*").alias("met"), F.min("part_n").alias("part_n"), F.max("best").alias("best")).where((F.col("met") == k) & (F.col("part_n") > F.col("n"))).drop("met", "part_n")
        now = written(now)
        new = now.where(passes & (share > F.col("best"))).select("tokens", "verdict", "m", share.alias("confidence"))
        found = new if found is None else found.unionByName(new)
        more = now.where("top < n")
        if more.isEmpty():
            return found
        before = more.select(F.col("tokens").alias("part"), "verdict", F.col("n").alias("part_n"), F.greatest("best", F.when(passes, share).otherwise(0.0)).alias("best"))
        going = more.select("tokens").distinct()
        hold = hold.join(going, "tokens")
        if k == 1:
            each = written(hold.select("row", F.col("last").alias("next")))
        longer = hold.join(each, "row").where("next > last")
        hold = written(longer.select("row", "verdict", "w", F.col("next").alias("last"), F.array_append("tokens", F.col("next")).alias("tokens")))


def mine(labelled: DataFrame, support: float = 0.01, confidence: float = 0.9, pages: DataFrame | None = None) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support) from all rows (tokens, verdict, key); pages: (token, pages) over all pages.

    Rows of the same tokens and verdict are one row that counts as often.
    """
    sets = written(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("w")).withColumn("row", F.monotonically_increasing_id()))
    n = sets.agg(F.sum("w")).first()[0] or 0
    least = max(support * n - 1e-9, 1)
    rules = _levels(written(_kept(sets, least, pages)), least, confidence)
    rules = rules.select("tokens", "verdict", "confidence", (F.col("m") / max(n, 1)).alias("support"))
    return rules.withColumn("rule_id", F.xxhash64("tokens", "verdict"))


def fitting(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, and the columns of rules) wherever a set (key, tokens) holds all tokens of a rule: an inverted index."""
    index = rules.select("rule_id", F.explode("tokens").alias("token"))
    hits = sets.select("key", F.explode("tokens").alias("token")).join(index, "token").groupBy("key", "rule_id").agg(F.count("*").alias("met"))
    return hits.join(rules, "rule_id").where("met = size(tokens)").drop("met")


def contrasted(rules: DataFrame, pages: DataFrame, lift: float) -> DataFrame:
    """The rules that pages of their verdict meet more often than all pages do, by the factor `lift`; pages: key, tokens, given (null where undecided)."""
    sets = written(pages.groupBy("key", "tokens").agg(F.count("*").alias("pages"), F.count_if(F.col("given") == "block").alias("block"), F.count_if(F.col("given") == "allow").alias("allow")))
    all_pages = sets.agg(*(F.sum(c).alias(f"all_{c}") for c in ("pages", "block", "allow")))  # one row
    met = fitting(sets, rules).join(sets.drop("tokens"), "key").groupBy("rule_id").agg(*(F.sum(c).alias(c) for c in ("pages", "block", "allow")))
    mine_of = lambda prefix="": F.when(F.col("verdict") == "block", F.col(f"{prefix}block")).otherwise(F.col(f"{prefix}allow"))
    weighed = rules.join(met, "rule_id").crossJoin(F.broadcast(all_pages))
    return weighed.where(mine_of() * F.col("all_pages") >= lift * F.col("pages") * mine_of("all_")).select(rules.columns)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", lift: float = 1.05, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, and the tokens of the mined rule that decided."""
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).withColumns({"host": host, "path": path})
    rule, verdict = decided(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "given": verdict, "tokens": url_tokens(F.col("url"), F.col("host"), F.col("path"))}).withColumn("key", F.concat_ws(" ", "tokens"))
    candidates = mine(base.where("given is not null").select("tokens", F.col("given").alias("verdict"), F.concat_ws("|", "url", F.col("page_id").cast("string")).alias("key")), pages=base.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("pages")), **mining)
    mined = written(contrasted(written(candidates), base.select("key", "tokens", "given"), lift))
    fits = fitting(base.where("given is null").select("key", "tokens").distinct(), mined)
    order = ("confidence", "support", "verdict", "tokens")
    best = fits.groupBy("key").agg(F.max_by(F.struct("verdict", "tokens"), F.struct(*order)).alias("best"))
    out = base.join(best.select("key", F.col("best.verdict").alias("found"), F.col("best.tokens").alias("mined")), "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "found", F.lit("allow")).alias("verdict"), F.when(F.col("given").isNull(), F.concat_ws(" ", "mined")).alias("mined_rule"))
