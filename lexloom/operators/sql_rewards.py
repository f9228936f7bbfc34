"""Rewards of SQL answers by running them: is there a query, does it parse, do its names exist, does it run, is its result right."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

#: What each rung is worth.
NO_QUERY, NO_PARSE, NO_SUCH_NAME, NO_RUN, WRONG, RIGHT = 0.0, 0.1, 0.3, 0.5, 0.7, 1.0
#: Words that may follow a table without an alias.
CLAUSES = "where|group|order|having|limit|join|inner|left|right|full|cross|semi|anti|natural|on|using|union|except|intersect|lateral|window|sort|cluster|distribute|tablesample|pivot|unpivot"
FENCED = re.compile(r"```sql\s+(.*?)```", re.S | re.I)


def query_of(answer: str | None) -> str | None:
    """The one fenced query of an answer; answers with none or several have no query."""
    found = FENCED.findall(answer or "")
    return found[0].strip().rstrip(";") if len(found) == 1 else None


def reward(spark: SparkSession, answer: str | None, wanted: DataFrame, tables: dict[str, DataFrame]) -> float:
    """The reward of one answer. Results are equal if they hold the same rows as often, in any order; nothing but a query over `tables` is run."""
    sql = query_of(answer)
    if sql is None:
        return NO_QUERY
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException:
        return NO_PARSE
    if not re.match(r"(?i)\s*(select|with|\()", sql) or "Insert" in plan.getClass().getName():
        return NO_PARSE
    named = re.sub(r"[{}]", lambda m: m[0] * 2, sql)
    for t in tables:
        named = re.sub(rf"\b(from|join)(\s+){t}\b(?=\s+(?:as\s+)?(?!(?:{CLAUSES})\b)[a-z_])", rf"\1\2{{{t}}}", named, flags=re.I)  # with an alias of its own
        named = re.sub(rf"\b(from|join)(\s+){t}\b", rf"\1\2{{{t}}} {t}", named, flags=re.I)
    try:
        got = spark.sql(named, **{t: df for t, df in tables.items() if f"{{{t}}}" in named})
    except AnalysisException:
        return NO_SUCH_NAME
    try:
        got.write.format("noop").mode("overwrite").save()
    except PySparkException:
        return NO_RUN
    if len(got.columns) != len(wanted.columns):
        return WRONG
    got = got.toDF(*wanted.columns)
    try:
        return RIGHT if got.exceptAll(wanted).isEmpty() and wanted.exceptAll(got).isEmpty() else WRONG
    except PySparkException:
        return WRONG  # columns of kinds that do not compare


def rewards(spark: SparkSession, answers: list[tuple[int, str | None]], wanted: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """id, reward of some answers to one task; each is a Spark query of its own."""
    return spark.createDataFrame([(i, reward(spark, a, wanted, tables)) for i, a in answers], "id long, reward double")
