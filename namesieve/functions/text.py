"""Name cleaning and shingles as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import EMPTY, HASH_MOD, SHINGLE

#: Unicode white space, as a regular-expression class.
SPACE = " \\t-\\r\\x1c-\\x1f\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_name(name: Column, nfkc: bool = True) -> Column:
    """Compatibility-normalise, lower, keep a-z and white space, collapse white space, trim; null stays null.

    Only texts beyond ASCII are sent to the normaliser.
    """
    if nfkc:
        name = F.coalesce(F.pandas_udf(_nfkc, "string")(F.when(name.rlike(r"[^\x00-\x7f]"), name)), name)
    kept = F.regexp_replace(F.lower(name), f"[^a-z{SPACE}]", "")
    return F.trim(F.regexp_replace(kept, f"[{SPACE}]+", " "))


def cleaned(name: str) -> str:
    """clean_name for one text in Python, for functions of Arrow batches."""
    return re.sub(f"[{SPACE}]+", " ", re.sub(f"[^a-z{SPACE}]", "", unicodedata.normalize("NFKC", name).lower())).strip(" ")


def shingles(clean: Column, size: int = SHINGLE) -> Column:
    """Distinct trigrams of a cleaned name; the whole of a shorter one; one marker for an empty one."""
    n = F.length(clean)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.substr(clean, i, F.lit(size))))
    return F.when(n >= size, grams).when(n > 0, F.array(clean)).when(n == 0, F.array(F.lit(EMPTY)))


def sorted_shingles(clean: Column) -> Column:
    """The shingles in ascending order, for display."""
    return F.array_sort(shingles(clean))


def yes_no(flag: Column) -> Column:
    """Y or N; null stays null."""
    return F.when(flag, "Y").when(~flag, "N")


def positions(text: str) -> list[int]:
    """The numbers of a comma-separated list; blanks are skipped."""
    return [int(x) for x in text.split(",") if x.strip()]


def hash20(text: Column) -> Column:
    """SHA-256 as an integer mod 2^20: its last five hexadecimal digits."""
    return F.conv(F.right(F.sha2(text, 256), F.lit(5)), 16, 10).cast("long") % HASH_MOD
