"""Marked blocks in texts that are snapshots of records: which are stale, and the texts with fresh ones.

A block is a line `<!-- block:NAME -->`, its body, and a line `<!-- /block -->`.
Bodies and records are compared as JSON values, so neither the order of keys nor
white space nor trailing zeros of a number (1.0 is 1) make a block stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = r"<!-- block:([A-Za-z0-9_.-]+) -->\n([\s\S]*?)\n<!-- /block -->"


def canonical(json: Column) -> Column:
    """A JSON text with sorted keys and no white space; null if it is none."""
    return F.to_json(F.try_parse_json(json))


def rendered(name: Column, json: Column) -> Column:
    """The block of a record, as `blocks` finds it."""
    return F.concat(F.lit("<!-- block:"), name, F.lit(" -->\n"), json, F.lit("\n<!-- /block -->"))


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, place (from 0), name, body: every block of each text in its order; none of a null text. An opened block without an end is no block."""
    group = lambda i: F.regexp_extract_all(text, F.lit(BLOCK), F.lit(i))
    found = docs.select(key, F.posexplode(F.arrays_zip(group(1).alias("name"), group(2).alias("body"))).alias("place", "b"))
    return found.select(key, F.col("place").cast("long").alias("place"), "b.name", "b.body")


def states(docs: DataFrame, records: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, place, name, state: `current`, `stale`, `malformed` (the body is no JSON) or `unknown` (no record of that name, or one without JSON)."""
    known = records.select("name", canonical(F.col("json")).alias("fresh"))
    met = blocks(docs, key, text).withColumn("own", canonical(F.col("body"))).join(known, "name", "left")
    state = F.when(F.col("fresh").isNull(), "unknown").when(F.col("own").isNull(), "malformed").when(F.col("own") == F.col("fresh"), "current").otherwise("stale")
    return met.select(key, "place", "name", state.alias("state"))


def refreshed(docs: DataFrame, records: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, n_refreshed: texts whose stale or malformed blocks hold their record's JSON again; keys are one a row."""
    known = records.select("name", canonical(F.col("json")).alias("fresh")).where("fresh is not null")
    met = blocks(docs, key, text).join(known, "name").where(~canonical(F.col("body")).eqNullSafe(F.col("fresh")))
    swap = F.struct(rendered(F.col("name"), F.col("body")).alias("old"), rendered(F.col("name"), F.col("fresh")).alias("new"))
    swaps = met.groupBy(key).agg(F.collect_list(swap).alias("swaps"))  # the blocks of one text
    out = docs.select(key, text).join(swaps, key, "left")
    fresh = F.aggregate("swaps", F.col(text), lambda t, s: F.replace(t, s["old"], s["new"]))
    return out.select(key, F.coalesce(fresh, F.col(text)).alias(text), F.greatest(F.coalesce(F.size("swaps"), F.lit(0)), F.lit(0)).cast("long").alias("n_refreshed"))
