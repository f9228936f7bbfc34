"""Column -> Column text functions, all on the JVM side.

Tokenised arrays are used more than once by most callers; Catalyst would
inline the regex at each use, so `tokens_table` puts a non-foldable barrier
(an `explode` of a one-element array) between tokenising and its uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "[a-z0-9']+"


def words(text: Column) -> Column:
    """Lower-case words of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def ws_words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def ngrams(tokens: Column, n: int) -> Column:
    """All windows of n tokens, blank-joined; empty for a shorter text."""
    return F.when(
        F.size(tokens) >= n,
        F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " ")),
    ).otherwise(F.array().cast("array<string>"))


def shingles(tokens: Column, n: int = 5) -> Column:
    """Distinct windows of n tokens; a shorter text is one shingle of all its words (none for no words)."""
    return F.when(F.size(tokens) >= n, F.array_distinct(ngrams(tokens, n))).otherwise(
        F.when(F.size(tokens) > 0, F.array(F.array_join(tokens, " "))).otherwise(F.array().cast("array<string>"))
    )


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`withColumn` whose value is computed once, however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def md5_bucket(x: Column) -> Column:
    """The first 32 bits of md5 as a bigint; the same number in other engines."""
    return F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("bigint")
