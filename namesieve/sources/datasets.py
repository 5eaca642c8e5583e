"""Readers of matching data sets: (queries(query_id, name, label), database(id, name)).

Identity is the zero-based position in the file, which seeds, column numbers
and ties depend on; files are read by many tasks, with line feeds in quotes (see
split_csv).  Columns are checked by name, blank names are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .split_csv import positions, read_split

MOCK = {"ncvr": ("Person_", 100, 1000, 10), "libcat": ("BookTitle_", 80, 2000, 8)}
# Surnames of the mock census.
SURNAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis"]


def parse_bool(c: Column) -> Column:
    """true/1/yes/y and false/0/no/n, in any case; anything else fails."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin("true", "1", "yes", "y"), True).when(text.isin("false", "0", "no", "n"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV with a header, all columns text, RFC 4180 quotes; a byte-order mark is dropped.

    Quoted line feeds keep a file in one task; for large lists without them, `multi_line=False` splits it.
    """
    df = spark.read.csv(str(path), header=True, quote='"', escape='"', multiLine=multi_line, encoding="UTF-8")
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns))


def require_columns(df: DataFrame, required: list[str], path: str) -> None:
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}")
    require_rows(df, path)


def require_rows(df: DataFrame, path: str) -> None:
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")


def ncvr_paths(path: str) -> tuple[Path, Path]:
    """(database, queries) of the 10k set in a folder or its ncvr_10k subfolder."""
    root = Path(path)
    if root.is_file():
        raise ValueError(f"{path} is a file; give the folder")
    for folder in (root, root / "ncvr_10k"):
        found = folder / "ncvr_10k_database.csv", folder / "ncvr_10k_queries.csv"
        if all(x.is_file() for x in found):
            return found
    raise FileNotFoundError(f"no ncvr_10k files under {path}")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    df = read_split(spark, path)
    require_columns(df, ["query_ncid", "query_name", "label"], path)
    kept = df.withColumn("name", F.trim("query_name")).where("name <> ''").withColumn("label", parse_bool(F.col("label")))
    require_rows(kept, path)
    return positions(kept, "query_id").select("query_id", "name", "label")


def read_database(spark: SparkSession, path: str) -> DataFrame:
    df = read_split(spark, path)
    require_columns(df, ["ncid", "full_name"], path)
    kept = df.withColumn("name", F.trim("full_name")).where("name <> ''")
    require_rows(kept, path)
    return positions(kept, "id").select("id", "name")


def load_ncvr_10k(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    database, queries = ncvr_paths(path)
    return read_queries(spark, str(queries)), read_database(spark, str(database))


def mock_wide(spark: SparkSession, prefix: str, n_a: int, n_b: int, n_true: int) -> tuple[DataFrame, DataFrame]:
    name = F.concat(F.lit(prefix), F.col("id").cast("string"))
    return spark.range(n_a).select(F.col("id").alias("query_id"), name.alias("name"), (F.col("id") < n_true).alias("label")), spark.range(n_b).select("id", name.alias("name"))


def mock_census(spark: SparkSession, n_a: int = 50, n_b: int = 500, n_true: int = 20) -> tuple[DataFrame, DataFrame]:
    """Queries: surnames in turn, which are matches, then Random_<position>; the list: the same surnames, Random_<position + 100>, then Extra_<position>."""
    surname = F.get(F.array(*map(F.lit, SURNAMES)), (F.col("id") % len(SURNAMES)).cast("int"))
    named = lambda word, plus=0: F.concat(F.lit(word), (F.col("id") + plus).cast("string"))
    true = F.col("id") < n_true
    a = spark.range(n_a).select(F.col("id").alias("query_id"), F.when(true, surname).otherwise(named("Random_")).alias("name"), true.alias("label"))
    b = spark.range(n_b).select("id", F.when(true, surname).when(F.col("id") < n_a, named("Random_", 100)).otherwise(named("Extra_")).alias("name"))
    return a, b


def _wide(a_col: str, b_col: str, mock: Callable) -> Callable:
    def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        if not path or not Path(path).is_file():
            return mock(spark)
        df = read_split(spark, path)
        require_columns(df, [a_col, b_col, "match_label"], path)
        a = positions(df.where(F.col(a_col).isNotNull()), "query_id").select("query_id", F.col(a_col).alias("name"), parse_bool(F.col("match_label")).alias("label"))
        return a, positions(df.where(F.col(b_col).isNotNull()), "id").select("id", F.col(b_col).alias("name"))

    return load


def typo(name: Column, key: Column) -> Column:
    """The name with one letter replaced, by a hash of the key."""
    h = F.xxhash64(key)
    at = F.pmod(h, F.greatest(F.length(name), F.lit(1))).cast("int") + 1
    letter = F.char(97 + F.pmod(F.shiftright(h, 20), F.lit(26)))
    return F.when(F.length(name) > 2, F.overlay(name, letter, at, F.lit(1))).otherwise(name)


def synthesise_forenames(pool: DataFrame, n_b: int = 1000, n_match: int = 100, n_nonmatch: int = 100, fuzzy: float = 0.3, seed: int = 42, name: str = "Romanized Name") -> tuple[DataFrame, DataFrame]:
    """A list, matches from it (a share with a wrong letter), and names that are not in it, in seeded hash order."""
    names = pool.select(F.col(name).alias("name")).where("trim(name) <> ''").dropDuplicates()

    def drawn(df: DataFrame, n: int, salt: int, id_col: str) -> DataFrame:
        top = df.orderBy(F.xxhash64("name", F.lit(seed), F.lit(salt)), "name").limit(n)
        return top.withColumn(id_col, F.row_number().over(Window.orderBy(F.xxhash64("name", F.lit(seed), F.lit(salt)), "name")).cast("bigint") - 1)

    b = drawn(names, n_b, 0, "id").select("id", "name")
    match = drawn(b.select("name"), n_match, 1, "query_id")
    wrong = F.pmod(F.xxhash64("name", F.lit(seed), F.lit(2)), F.lit(1 << 20)) < fuzzy * (1 << 20)
    match = match.select("query_id", F.when(wrong, typo(F.col("name"), F.col("name"))).otherwise(F.col("name")).alias("name"), F.lit(True).alias("label"))
    rest = drawn(names.join(b, "name", "left_anti"), n_nonmatch, 3, "query_id")
    return match.unionByName(rest.select(F.col("query_id") + n_match, "name", F.lit(False).alias("label")).toDF("query_id", "name", "label")), b


def load_forenames(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    if not path or not Path(path).is_file():
        return mock_wide(spark, *MOCK["ncvr"])
    df = read_csv(spark, path)
    require_columns(df, ["Romanized Name"], path)
    return synthesise_forenames(df)


LOADERS: dict[str, Callable[[SparkSession, str], tuple[DataFrame, DataFrame]]] = {
    "ncvr_10k": load_ncvr_10k,
    "ncvr": _wide("name_A", "name_B", lambda s: mock_wide(s, *MOCK["ncvr"])),
    "libcat": _wide("title_A", "title_B", lambda s: mock_wide(s, *MOCK["libcat"])),
    "census": _wide("name_A", "name_B", mock_census),
    "forenames": load_forenames,
}


def load_dataset(spark: SparkSession, name: str, path: str = "", query_limit: int = 0, db_limit: int = 0) -> tuple[DataFrame, DataFrame]:
    """Queries and database of a known data set, cut to the first rows where limits are positive; labels refer to the whole database."""
    if name.lower() not in LOADERS:
        raise ValueError(f"unknown data set {name}; known: {', '.join(LOADERS)}")
    queries, database = LOADERS[name.lower()](spark, path)
    if query_limit > 0:
        queries = queries.where(F.col("query_id") < query_limit)
    if db_limit > 0:
        database = database.where(F.col("id") < db_limit)
    return queries, database


def pick(queries: DataFrame, positions: list[int], n: int) -> DataFrame:
    """The queries at these positions."""
    if bad := [i for i in positions if not 0 <= i < n]:
        raise ValueError(f"positions out of range: {bad}")
    return queries.where(F.col("query_id").isin(positions))


def card(queries: DataFrame, database: DataFrame, name: str, samples: int = 10) -> dict:
    """What a data set holds: numbers of records, of queries by label, and the first of each."""
    counts = queries.agg(F.count("*").alias("n"), F.count_if("label").alias("positive")).first()
    first = queries.orderBy("query_id").limit(samples).collect()
    return {
        "dataset": name,
        "total_records_b": database.count(),
        "total_queries_a": counts.n,
        "positive_queries": counts.positive,
        "negative_queries": counts.n - counts.positive,
        "sample_names_b": [r.name for r in database.orderBy("id").limit(samples).collect()],
        "sample_queries_a": [{"index": r.query_id, "name": r.name, "label": r.label} for r in first],
    }
