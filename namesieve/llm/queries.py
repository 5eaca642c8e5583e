"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, filteraudit, fingerprint, langid, lmscore, manifest, neardup, packing, pii, repeats, simhash, tokenbin, urlrules

#: SQL's name for a run of word characters: everything but ASCII signs and white space, Latin-1 signs and general punctuation.
SQL_WORD = r"[^\x00-/:-@\[-`{-\x7f\x{80}-\x{bf}\x{2000}-\x{207f}\x{3000}-\x{303f}]+"

SQL_SIGN = SQL_WORD.replace("[^", "[", 1).removesuffix("+") + "*"
#: Words from which on a removed span counts as a passage.
PASSAGE = 50
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, sf_dir))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    profiles = langid.fit(docs, ~langid.held_out())
    found = langid.predict(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), size=1024, end_id=2)


def op4_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokenbin.write_token_files(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return tokenbin.read_token_files(spark, manifest)


def op5_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.lm_scores(_documents(spark, sf_dir)).select("doc_id", "n_words", F.round("score", 6).alias("score"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(_documents(spark, sf_dir))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(_documents(spark, sf_dir))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    words = F.aggregate("words", F.lit(0), lambda s, x: s + x).cast("long")
    return cleaned.select("doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"), words.alias("n_words_removed"), F.coalesce(F.array_max("words"), F.lit(0)).cast("long").alias("longest_removed"), F.size(F.filter("words", lambda x: x >= PASSAGE)).cast("long").alias("n_passages"), F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op9_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pii.detect(docs, pii.fit(docs))


def op11_filteraudit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(filteraudit.flagged(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    built = manifest.build(_documents(spark, sf_dir), MANIFEST_FIELDS, changed={"text": F.translate("text", ascii_uppercase, ascii_lowercase)}, where=chosen)
    return manifest.prove(built).withColumn("proof", F.sha2("proof", 256)).withColumnRenamed("proof", "proof_sha256")


QUERIES = {f.__name__: f for f in (op1_neardup, op2_langid, op3_packing, op4_tokenbin, op5_lmscore, op6_fingerprint, op7_decontam, op8_repeats, op9_urlrules, op10_pii, op11_filteraudit, op12_simhash, op13_manifest)}



def _sql_node(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return f"sha256({' || '.join(_sql_node(f) for f in [*MANIFEST_FIELDS[:-1], text])})"


def _sql_tree(name: str, group: str, levels: int) -> str:
    """Levels of a tree over table {name}0 (group, pos, digest, n): {name}1 and so on; a group of one node is done."""
    each = (f"{name}{k + 1} AS (SELECT {group}, pos // 16 AS pos, string_agg(digest, '' ORDER BY pos) AS t, sha256(string_agg(digest, '' ORDER BY pos)) AS digest, (n + 15) // 16 AS n FROM {name}{k} WHERE n > 1 GROUP BY ALL)" for k in range(levels))
    return ", ".join(each)


def _sql_fold(name: str, on: str, levels: int, pos: str, fold: str) -> tuple[str, str, str]:
    """Joins, siblings and recomputed digest on the way up such a tree."""
    joins, pieces = [], []
    for k in range(1, levels + 1):
        at = f"64 * (({pos} // {16 ** (k - 1)}) % 16)"
        before, behind = f"substr({name}{k}.t, 1, {at})", f"substr({name}{k}.t, {at} + 65)"
        joins.append(f"LEFT JOIN {name}{k} ON {on.format(f'{name}{k}')} AND {name}{k}.pos = {pos} // {16**k}")
        pieces.append(f"coalesce({before} || {behind}, '')")
        fold = f"CASE WHEN {name}{k}.t IS NULL THEN {fold} ELSE sha256({before} || {fold} || {behind}) END"
    return " ".join(joins), " || ".join(pieces), fold


def _sql_manifest(levels: int = 6, tops: int = 4) -> str:
    """For groups of up to 16^levels rows, and 16^tops groups."""
    low = f"translate(text, '{ascii_uppercase}', '{ascii_lowercase}')"
    crc = "list_reduce(list_transform(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])), lambda x: x::BIGINT), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295)"
    up, inner, fold = _sql_fold("s", "{0}.g = l.g", levels, "l.pos", "l.changed")
    up2, outer, fold2 = _sql_fold("r", "true", tops, "r0.pos", "f.fold")
    found = lambda name, n: " UNION ALL ".join(f"SELECT * FROM (SELECT {'g, ' if name == 's' else ''}digest FROM {name}{k} WHERE n = 1)" for k in range(n + 1))
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '-') AS g, {_sql_leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {_sql_leaf(low)} END AS other FROM documents),
l AS MATERIALIZED (SELECT *, coalesce(other, leaf) AS changed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
s0 AS (SELECT g, pos, leaf AS digest, n FROM l), {_sql_tree('s', 'g', levels)},
sub AS ({found('s', levels)}),
r0 AS MATERIALIZED (SELECT 1 AS one, g, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM sub), {_sql_tree('r', 'one', tops)},
root AS ({found('r', tops)}),
f AS (SELECT l.doc_id, l.leaf, l.g, {inner} AS inner_proof, {fold} AS fold FROM l {up}),
o AS (SELECT f.doc_id, f.leaf, r0.digest AS subroot, f.inner_proof || {outer} AS proof, {fold2} AS folded_root FROM f JOIN r0 USING (g) {up2})
SELECT doc_id, leaf, subroot, root.digest AS root, sha256(proof) AS proof_sha256, folded_root, folded_root = root.digest AS verified FROM o CROSS JOIN root
"""


ORACLES = {
    "op11_filteraudit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, doc_id > min(doc_id) OVER (PARTITION BY text) AS copy FROM d),
m AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
flags AS (SELECT part, ['A', 'B', 'C', 'D', 'E'] AS letters, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(copy, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN m USING (doc_id)),
f AS (SELECT part, good, toxic, list_filter(letters, lambda x, i: fails[i]) AS failing FROM flags),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
first AS (SELECT f.*, filter_order, coalesce(list_min(list_transform(failing, lambda x: strpos(filter_order, x))), 6) AS gone FROM f CROSS JOIN o),
c AS (SELECT part, filter_order, step::INT AS step, substr(filter_order, step, 1) AS letter, count(*) FILTER (gone > step) AS kept, count(*) FILTER (gone = step) AS removed,
      count(*) FILTER (list_contains(failing, substr(filter_order, step, 1)) AND gone < step) AS redundant, count(*) FILTER (failing = [substr(filter_order, step, 1)]) AS unique_fails,
      count(*) FILTER (gone = step AND good) AS good_lost, count(*) FILTER (gone = step AND toxic) AS toxic_lost
      FROM first, unnest([1, 2, 3, 4, 5]) AS steps(step) GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM c
""",
    "op13_manifest": _sql_manifest(),
    "op5_lmscore": rf"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{SQL_WORD}')) AS w, generate_subscripts(regexp_extract_all(lower(coalesce(text, '')), '{SQL_WORD}'), 1) AS i FROM documents),
p AS (SELECT doc_id, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
size AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
total AS (SELECT count(*) AS n FROM w),
own1 AS (SELECT doc_id, w, count(*) AS c FROM w GROUP BY 1, 2),
all1 AS (SELECT w, sum(c) AS c FROM own1 GROUP BY 1),
own2 AS (SELECT doc_id, v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY 1, 2, 3),
all2 AS (SELECT v, w, sum(c) AS c FROM own2 GROUP BY 1, 2),
own3 AS (SELECT doc_id, u, v, w, count(*) AS c FROM p WHERE u IS NOT NULL GROUP BY 1, 2, 3, 4),
all3 AS (SELECT u, v, w, sum(c) AS c FROM own3 GROUP BY 1, 2, 3),
s AS (SELECT p.doc_id, p.u, p.v, a1.c - o1.c AS c1, total.n - size.n AS rest, a2.c - o2.c AS c2, av.c - ov.c AS cv, a3.c - o3.c AS c3, au.c - ou.c AS cu
      FROM p JOIN own1 o1 USING (doc_id, w) JOIN all1 a1 USING (w) JOIN size USING (doc_id) CROSS JOIN total
      LEFT JOIN own2 o2 ON o2.doc_id = p.doc_id AND o2.v = p.v AND o2.w = p.w LEFT JOIN all2 a2 ON a2.v = p.v AND a2.w = p.w
      LEFT JOIN own1 ov ON ov.doc_id = p.doc_id AND ov.w = p.v LEFT JOIN all1 av ON av.w = p.v
      LEFT JOIN own3 o3 ON o3.doc_id = p.doc_id AND o3.u = p.u AND o3.v = p.v AND o3.w = p.w LEFT JOIN all3 a3 ON a3.u = p.u AND a3.v = p.v AND a3.w = p.w
      LEFT JOIN own2 ou ON ou.doc_id = p.doc_id AND ou.v = p.u AND ou.w = p.v LEFT JOIN all2 au ON au.v = p.u AND au.w = p.v),
l AS (SELECT doc_id, ln(CASE WHEN c3 > 0 THEN c3 / greatest(cu, 1) ELSE (CASE WHEN u IS NULL THEN 1.0 ELSE 0.4 END) *
      (CASE WHEN c2 > 0 THEN c2 / greatest(cv, 1) ELSE (CASE WHEN v IS NULL THEN 1.0 ELSE 0.4 END) * (CASE WHEN c1 > 0 THEN c1 / rest::DOUBLE ELSE 0.4 / (rest + 1) END) END) END) AS l FROM s)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_words, round(m.score, 6) AS score
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT doc_id, avg(l) AS score FROM l GROUP BY 1) m USING (doc_id)
""",
    "op8_repeats": rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '{SQL_SIGN}{SQL_WORD}')) AS g, generate_subscripts(regexp_extract_all(text, '{SQL_SIGN}{SQL_WORD}'), 1) AS i FROM t),
w AS (SELECT doc_id, i, regexp_extract(g, '{SQL_WORD}') AS w, regexp_extract(g, '^{SQL_SIGN}') AS gap, sum(length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM tok),
b AS (SELECT *, e - length(w) AS s, sum(length(gap) - length(replace(gap, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i) AS line, (i = 1 OR regexp_matches(w, '^[A-Z\x{{c0}}-\x{{de}}]') OR regexp_matches(gap, '[.!?\n]'))::INT AS new FROM w),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS unit FROM b),
pieces AS (SELECT doc_id, unit, min(s) AS s, max(e) AS e, count(*) AS words, string_agg(lower(w), ' ' ORDER BY i) AS k FROM n GROUP BY 1, 2),
rows AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, len(string_split(text, chr(10))) AS many FROM t),
ends AS (SELECT doc_id, line, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(x) - 1 AS s, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line) - (line + 1 = many)::INT AS e FROM rows),
lines AS (SELECT doc_id, line, string_agg(lower(w), ' ' ORDER BY i) AS k FROM n GROUP BY 1, 2),
again AS (SELECT * FROM pieces QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, unit) > 1),
runs AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM again),
spans AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM runs GROUP BY doc_id, run HAVING sum(words) >= 10
          UNION ALL SELECT doc_id, ends.s, ends.e FROM (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, line) > 1) JOIN ends USING (doc_id, line)),
part AS (SELECT *, coalesce(s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM spans),
num AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS span FROM part),
gone AS (SELECT doc_id, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM num GROUP BY doc_id, span),
cut AS (SELECT doc_id, s, e, text, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev, len(list_filter(string_split_regex(substr(text, s + 1, e - s), '\s+'), lambda x: x <> '')) AS words FROM gone JOIN t USING (doc_id)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(s || ':' || e, ',' ORDER BY s) AS removed, sum(words) AS words, max(words) AS longest, count(*) FILTER (words >= {PASSAGE}) AS passages, string_agg(substr(text, prev + 1, s - prev), '' ORDER BY s) || substr(any_value(text), max(e) + 1) AS text FROM cut GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, coalesce(words, 0)::BIGINT AS n_words_removed, coalesce(longest, 0)::BIGINT AS longest_removed, coalesce(passages, 0)::BIGINT AS n_passages, length(coalesce(kept.text, t.text))::BIGINT AS n_chars_kept, sha256(coalesce(kept.text, t.text)) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
""",
}
