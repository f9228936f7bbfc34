"""Operator 12: filter interaction audit.

Five filters judge every whole text. Native expressions turn the four that look
at one text into bits of a mask; a grouping by text (its SHA-256, so that no text
is shuffled) supplies the smallest doc_id of each text for the fifth. What is
left of the corpus then is a histogram: documents by part and five-bit mask, at
most 32 cells a part. All 120 orders of the filters follow from the cells alone:
with S(U) the documents that fail no filter of U, a step that adds filter f to
the filters U before it keeps S(U + f) and removes S(U) - S(U + f).

Hot groups: a text that a third of all rows repeat is counted by (text, part,
labels) on the map side before its rows meet, and is one row for each part then.

Defined results: null text is empty, so all null and empty texts are copies of
one another; a null source is the part of the empty string. A row without an id
is no copy, as no id is smaller than none, and makes no other row a copy. Rows
of one id and text are no copies of each other. A document is good (toxic) if
any row of `labels` with its id says so; null labels say nothing. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import SPACES, written

FILTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
MARKS = "[#$%&*|]"
CELLS = 1 << len(FILTERS)
SUMS = ("n", "good", "toxic")


def masked(docs: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """id, part, text_id, bits: a bit for each of the filters A to D that the text fails."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), t.alias("text"), F.btrim(t, F.lit(SPACES)).alias("inner"))
    # an exploded array of one keeps the words from being made again at each use
    split = F.when(F.col("inner") == "", F.array().cast("array<string>")).otherwise(F.split("inner", r"[\x20\x09-\x0D]+"))
    rows = rows.select("id", "part", "text", F.explode(F.array(split)).alias("words"))
    capitals = F.regexp_count("text", F.lit("[A-Z]"))
    fails = (
        F.size("words") < FEWEST_WORDS,
        100 * F.size(F.array_distinct("words")).cast("long") < LEAST_DISTINCT * F.size("words").cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS * F.length("text").cast("long"),
        F.col("text").rlike(MARKS),
    )
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("text_id"), bits.alias("bits"))


def cells(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: the histogram of five-bit masks; bit k is set for documents that fail filter k."""
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.groupBy(F.col(key).alias("id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    rows = masked(docs, key, text, part).join(known, "id", "left").na.fill(False, ["good", "toxic"])
    of = ["text_id", "part", "bits", "good", "toxic"]
    once = rows.groupBy("id", *of).agg(F.count("*").alias("n"))
    by_text = once.groupBy(*of).agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_idless"),
    )
    by_text = written(by_text, "audit")
    smallest = by_text.groupBy("text_id").agg(F.min("first.id").alias("smallest"))
    found = by_text.join(smallest, "text_id")
    originals = F.col("n_idless") + F.when(F.col("first.id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    both = F.inline(F.array(F.struct(F.col("bits").alias("mask"), originals.alias("k")), F.struct((F.col("bits") + (1 << 4)).alias("mask"), (F.col("n") - originals).alias("k"))))
    split = found.select("part", "good", "toxic", both)
    return split.groupBy("part", "mask").agg(F.sum("k").alias("n"), F.sum(F.when(F.col("good"), F.col("k")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("k")).otherwise(0)).alias("toxic"))


def _at(sums: str, filters: Column) -> Column:
    """Documents (or good or toxic ones) that fail none of a set of filters."""
    return F.element_at(sums, filters + 1)


def orders(histogram: DataFrame) -> DataFrame:
    """Every order and step of each part of a histogram `cells`: what each filter removes, hides and loses."""
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*SUMS).alias("v"))))  # 32 entries at most
    parts = histogram.groupBy("part").agg(by_mask.alias("cells"))
    none = F.sequence(F.lit(0), F.lit(CELLS - 1))

    def passing(field: str) -> Column:
        value = lambda m: F.coalesce(F.element_at("cells", m)[field], F.lit(0)).cast("long")
        return F.transform(none, lambda u: F.aggregate(F.filter(none, lambda m: m.bitwiseAND(u) == 0), F.lit(0).cast("long"), lambda s, m: s + value(m)))

    for f in SUMS:
        parts = parts.select("*", F.explode(F.array(passing(f))).alias(f"s_{f}"))

    def shapley(k: int) -> Column:
        """What filter k removes, summed over all orders: U before it stands in |U|! (4 - |U|)! of them."""
        without = [u for u in range(CELLS) if not u >> k & 1]
        return F.expr(" + ".join(f"{factorial(u.bit_count()) * factorial(4 - u.bit_count())}L * (s_n[{u}] - s_n[{u | 1 << k}])" for u in without))

    parts = parts.select("*", F.explode(F.array(F.array(*[shapley(k) for k in range(5)]))).alias("shapleys"))
    every = F.expr("array(" + ", ".join(f"'{''.join(p)}'" for p in permutations(FILTERS)) + ")")
    steps = parts.select("*", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    filter_at = lambda i: F.instr(F.lit(FILTERS), F.substring("filter_order", i, F.lit(1))) - 1
    bits = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.pow(F.lit(2), filter_at(i)).cast("int"))
    upto = lambda n: F.aggregate(F.slice(bits, F.lit(1), n), F.lit(0), lambda s, b: s + b)
    steps = steps.select("*", filter_at(F.col("step")).alias("f"), upto(F.col("step") - 1).alias("before"), upto(F.col("step")).alias("after"))
    bit = F.pow(F.lit(2), F.col("f")).cast("int")
    gone = lambda f: _at(f"s_{f}", F.col("before")) - _at(f"s_{f}", F.col("after"))
    failing = _at("s_n", F.lit(0)) - _at("s_n", bit)
    alone = F.coalesce(F.element_at("cells", bit)["n"], F.lit(0)).cast("long")
    return steps.select(
        "part", "filter_order", "step", _at("s_n", F.col("after")).alias("kept"), gone("n").alias("removed"), (failing - gone("n")).alias("redundant"), alone.alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.element_at("shapleys", F.col("f") + 1).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row per part, order of the five filters and step."""
    return orders(cells(docs, labels, **columns))
