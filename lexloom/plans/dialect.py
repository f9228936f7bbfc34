"""Writing one query for both engines.

`Plans` collects the queries of a module. `both` takes SQL in which the few
functions that the engines spell differently are macros in capitals; the Spark
side runs it over DataFrames of the tables, the other string is the oracle.
Queries whose shapes differ are given as a function and a string of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.sources.tables import TABLES, table

#: macro -> (Spark, DuckDB); %s are the arguments, in order.
MACROS = {
    "WORDS": ("regexp_extract_all(lower(%s), \"([a-z0-9']+)\", 1)", "regexp_extract_all(lower(%s), '[a-z0-9'']+')"),
    "WSWORDS": (r"filter(split(%s, '\\s+'), e -> e <> '')", r"list_filter(regexp_split_to_array(%s, '\s+'), lambda e: e <> '')"),
    "H32": ("cast(conv(substring(md5(%s), 1, 8), 16, 10) as bigint)", "cast(('0x' || substr(md5(%s), 1, 8)) as bigint)"),
    "SIZE": ("cast(size(%s) as bigint)", "cast(len(%s) as bigint)"),
    "EACH": ("explode(%s)", "unnest(%s)"),
    "SEQ": ("sequence(%s, %s)", "range(%s, (%s) + 1)"),
    "JSONK": ("cast(get_json_object(%s, '$.k') as bigint)", "cast((cast(%s as json)->>'k') as bigint)"),
    "LINES": (r"split(%s, '\n')", "string_split(%s, chr(10))"),
    "DISTINCT_OF": ("array_distinct(%s)", "list_distinct(%s)"),
    "REPLACE_ALL": ("regexp_replace(%s, %s, %s)", "regexp_replace(%s, %s, %s, 'g')"),
    "MATCHES": ("(%s rlike %s)", "regexp_matches(%s, %s)"),
    "COUNT_RE": ("cast(regexp_count(%s, %s) as bigint)", "cast(len(regexp_extract_all(%s, %s)) as bigint)"),
    "FIRST_RE": ("regexp_extract(%s, %s, %s)", "regexp_extract(%s, %s, %s)"),
    "BYTES": ("cast(octet_length(%s) as bigint)", "cast(strlen(%s) as bigint)"),
    "IDIV": ("((%s) div (%s))", "((%s) // (%s))"),
    "MOD": ("((%s) %% (%s))", "((%s) %% (%s))"),
    "DBL": ("cast(%s as double)", "cast(%s as double)"),
    "BIG": ("cast(%s as bigint)", "cast(%s as bigint)"),
    "MAX_BY": ("max_by(%s, %s)", "max_by(%s, %s)"),
    "COUNT_IF": ("count_if(%s)", "cast(count(*) filter (where %s) as bigint)"),
    "JOINED": ("array_join(%s, %s)", "array_to_string(%s, %s)"),
    "PIECE": ("slice(%s, %s, %s)", "list_slice(%s, %s, %s)"),
    "LN": ("ln(%s)", "ln(%s)"),
    "R9": ("round(cast(%s as double), 9)", "round(cast(%s as double), 9)"),
    "R6": ("round(cast(%s as double), 6)", "round(cast(%s as double), 6)"),
}


def _arguments(sql: str, at: int) -> tuple[list[str], int]:
    """The arguments of the call whose bracket opens at `at`, and the place after it."""
    depth, quote, start, out = 0, None, at + 1, []
    for i in range(at, len(sql)):
        c = sql[i]
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return [*out, sql[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(sql[start:i].strip())
            start = i + 1
    raise ValueError(f"unclosed bracket in {sql[at:at + 60]}")


def expand(sql: str, spark: bool) -> str:
    while m := re.search(rf"\b({'|'.join(MACROS)})\(", sql):
        args, end = _arguments(sql, m.end() - 1)
        sql = sql[: m.start()] + MACROS[m[1]][0 if spark else 1] % tuple(args) + sql[end:]
    return sql


class Plans:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def both(self, name: str, sql: str, spark_sql: str | None = None) -> None:
        """One text for both engines, or one for each."""
        self.queries[name] = spark_query(expand(spark_sql or sql, True))
        self.oracles[name] = expand(sql, False)

    def add(self, name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
        self.queries[name] = query
        if oracle:
            self.oracles[name] = expand(oracle, False)


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b(?:from|join)\s+{t}\b", sql)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # tables go in as DataFrames, so no name is left behind in the catalog
        text = re.sub(r"[{}]", lambda m: m[0] * 2, sql)
        for t in used:
            text = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}} {t}", text)
        return spark.sql(_single_alias(text), **{t: table(spark, sf_dir, t) for t in used})

    return query


def _single_alias(text: str) -> str:
    """`from {t} t alias` is `from {t} alias` if an alias was given."""
    words = "where|group|order|join|left|right|inner|cross|full|limit|union|on|lateral|having|window|semi|anti|using|except|intersect|select"
    return re.sub(rf"(\{{\w+\}}) \w+ (?:as )?(?!(?:{words})\b)([a-z]\w*)", r"\1 \2", text)
