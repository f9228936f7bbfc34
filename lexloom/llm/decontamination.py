"""Operator 4: benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, capitalised names and units of both sides become typed placeholders;
windows of `n` template tokens are hashed and joined; for each match the values
behind the placeholders must map one to one, so that a passage with other
numbers and names is caught and one that merely has the same frame with mixed-up
slots is not. Windows need `min_literal` tokens that are no placeholders.
Beside them the windows of case-folded tokens are hashed and joined, so that a
copy in other case, whose names are no <name> or whose words all are, is caught too.
An item of fewer than n tokens is one case-folded window of its own length; documents
are hashed at such lengths only if the benchmark has them. One of fewer than
`min_literal` tokens may be a phrase that everyone says, so it counts only if at most
`COMMON_SHARE` of the rows hold it (or one row does).

The corpus is read twice. A window of n tokens holds, whatever its place, a run of
`GRAM` tokens at one of every n - GRAM + 1 places, so the first pass hashes only the
runs at these places (8 bytes and a position each, met in the scan's own stage by the
broadcast hashes of all runs in the benchmark's windows, in blocks of at most
`BLOCK_WINDOWS`). The second reads the documents that had a hit, cuts the windows
around it, and joins them by the hash of the whole window.

Defined results: null and empty texts match nothing; each input row gives one output row, repeated rows alike;
other columns are ignored. n_windows counts the template windows of an item, and
the case-folded windows of an item that no template window meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import narrowed, written

WINDOW, MIN_LITERAL, GRAM = 10, 5, 5
#: Share of the rows that may hold an item of fewer than MIN_LITERAL tokens.
COMMON_SHARE = 0.01
#: Windows of the benchmark that one pass over the corpus broadcasts (24 bytes each).
BLOCK_WINDOWS = 1_000_000
#: Windows of the benchmark, tokens included (some 300 bytes each), that are broadcast at most.
BROADCAST_ITEMS = 100_000
#: A column name that no input has.
ROW = "__lexloom_row"
#: Units of measure and currency.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons ml l liter liters litre litres "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees watt watts volt volts"
).split()
TOKEN = r"[\p{L}\p{N}]+(?:['’.,][\p{L}\p{N}]+)*"


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once, however often it is used."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def kind(token: Column) -> Column:
    """The placeholder of a token, or the token in lower case."""
    low, number = F.lower(token), (token >= "0") & (token < ":")
    plain = F.when(number, F.lit("<num>")).when(token.isin(UNITS), F.lit("<unit>")).otherwise(token)
    second = F.substring(token, 2, 1)
    name = (F.substring(token, 1, 1) != F.substring(low, 1, 1)) & (second == F.lower(second))
    return F.when(token == low, plain).otherwise(F.when(number, F.lit("<num>")).when(name, F.lit("<name>")).when(low.isin(UNITS), F.lit("<unit>")).otherwise(low))


def token_list(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def tokens(df: DataFrame, text: str) -> DataFrame:
    """+ w: tokens, c: template tokens."""
    return held(held(df, "w", token_list(text)), "c", F.transform("w", kind))


def starts(n: int) -> Column:
    return F.when(F.size("c") >= n, F.sequence(F.lit(1), F.size("c") - (n - 1))).otherwise(F.array().cast("array<int>"))


def folded(words: Column | str) -> Column:
    return F.transform(words, F.lower)


def numbers(words: Column | str) -> Column:
    """A hash of each token; windows are hashed from these, as a token is in many windows."""
    return F.transform(words, lambda t: F.xxhash64(t))


def hashed(run: Column) -> Column:
    return F.xxhash64(numbers(run))


def runs(n: int, gram: int, short: list[int]) -> Column:
    """x: (at, size, whole, h), hashes of the runs of template tokens (numbers in nc) and of case-folded ones (nl) at every (n - gram + 1)th place, and of whole case-folded windows of the sizes in `short`."""

    def of(c: str, size: int, step: int, whole: bool) -> Column:
        at = F.when(F.size("nc") >= size, F.sequence(F.lit(1), F.size("nc") - (size - 1), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), F.lit(whole).alias("whole"), F.xxhash64(F.slice(c, i, F.lit(size))).alias("h")))

    step = n - gram + 1
    return F.explode(F.concat(of("nc", gram, step, False), of("nl", gram, step, False), *(of("nl", m, 1, True) for m in short))).alias("x")


def literal(window: Column) -> Column:
    return F.size(F.filter(window, lambda t: ~t.startswith("<")))


def matches(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, min_literal: int = MIN_LITERAL, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """row (a hash of id and text), item, n_windows: consistent windows of each document row and benchmark item."""
    all_ = tokens(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("t")), "t")
    items = all_.select("item", F.explode(F.transform(starts(n), lambda i: F.struct(F.slice("w", i, F.lit(n)).alias("bw"), F.slice("c", i, F.lit(n)).alias("bc")))).alias("x"))
    items = items.select("item", "x.bw", "x.bc")
    framed = items.where(literal(F.col("bc")) >= min_literal).select("*", hashed(F.col("bc")).alias("h"), F.lit(False).alias("as_folded"))
    whole = all_.where((F.size("w") > 0) & (F.size("w") < n)).select("item", F.col("w").alias("bw"), F.col("c").alias("bc"))
    items = framed.union(items.union(whole).select("*", hashed(folded("bw")).alias("h"), F.lit(True))).distinct()
    items = written(items, "decontamination-windows")
    gram = min(GRAM, n)
    short = sorted(r[0] for r in items.where(F.size("bw") < n).select(F.size("bw")).distinct().collect())  # n - 1 sizes at most
    inside = F.transform(F.sequence(F.lit(1), F.lit(n - gram + 1)), lambda i: hashed(F.slice("t", i, F.lit(gram))))
    parts = items.withColumn("t", F.when(F.col("as_folded"), folded("bw")).otherwise(F.col("bc"))).select(F.explode(F.when(F.size("bw") < n, F.array("h")).otherwise(inside)).alias("h"))
    parts = written(parts.distinct(), "decontamination-runs")
    n_items = items.count()
    blocks = max(1, -(-parts.count() // BLOCK_WINDOWS))
    rows = docs.select(F.xxhash64(key, text).alias("row"), F.col(text).alias("t"))
    words = held(rows.select("row", "t"), "w", token_list("t"))
    scanned = held(held(words, "nc", F.transform("w", lambda t: F.xxhash64(kind(t)))), "nl", numbers(folded("w"))).select("row", runs(n, gram, short)).select("row", "x.at", "x.size", "x.whole", "x.h")
    hits = None
    for b in range(blocks):
        part = parts.where(F.pmod("h", F.lit(blocks)) == b)
        found = scanned.join(F.broadcast(part), "h", "left_semi")
        hits = found if hits is None else hits.union(found)
    hits = written(written(hits, "decontamination-hits").groupBy("row").agg(F.collect_set(F.struct("at", "size", "whole")).alias("x")), "decontamination-hits")
    again = tokens(narrowed(rows, hits.select("row"), "row").dropDuplicates(["row"]).join(hits, "row"), "t")
    last = F.size("c") - (n - 1)

    # a place is one number, start and size, as Spark finds equal structs in an array by comparing all with all
    code = lambda at, size: F.shiftleft(at.cast("long"), 32) + size

    def around(x: Column) -> Column:
        lo, hi = F.greatest(F.lit(1), x["at"] - (n - gram)), F.least(x["at"], last)
        wide = F.when(hi >= lo, F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda i: code(i, F.lit(n))))
        return F.when(x["whole"], F.array(code(x["at"], x["size"]))).otherwise(F.coalesce(wide, F.array().cast("array<bigint>")))

    places = F.array_distinct(F.flatten(F.transform("x", around)))
    # windows are cut before they become rows: an explode copies what is selected beside it
    at, size = lambda x: F.shiftright(x, 32).cast("int"), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    cut = lambda x: F.struct(F.slice("w", at(x), size(x)).alias("dw"), F.slice("c", at(x), size(x)).alias("dc"))
    seen = again.select("row", F.explode(F.transform(places, cut)).alias("y")).select("row", "y.dw", "y.dc")
    seen = seen.select("row", "dw", "dc", F.explode(F.array_distinct(F.array(hashed(F.col("dc")), hashed(folded("dw"))))).alias("h"))
    # a passage that very many documents hold is one key: broadcast items need no group of it
    met = seen.join(F.broadcast(items) if n_items <= BROADCAST_ITEMS else items, "h").where(F.when(F.col("as_folded"), folded("bw") == folded("dw")).otherwise(F.col("bc") == F.col("dc")))
    slot = lambda i: F.struct(F.element_at("bc", i).alias("k"), F.lower(F.element_at("bw", i)).alias("b"), F.lower(F.element_at("dw", i)).alias("d"))
    pairs = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.size("bc")), slot), lambda s: s["k"].startswith("<")))
    met = held(met, "p", pairs)
    side = lambda f: F.size(F.array_distinct(F.transform("p", lambda s: F.struct(s["k"], s[f]))))
    consistent = met.where(F.col("as_folded") | ((side("b") == F.size("p")) & (side("d") == F.size("p"))))
    if short and short[0] < min_literal:
        tiny = F.size("bw") < min_literal
        often = written(consistent.where(tiny).groupBy("item").agg(F.count_distinct("row").alias("n_rows")), "decontamination-tiny")
        common = often.where(F.col("n_rows") > max(1, COMMON_SHARE * docs.count())).select("item")  # a row an item that short
        consistent = consistent.where(~tiny).union(consistent.where(tiny).join(common, "item", "left_anti").select(consistent.columns))
    by_item = consistent.groupBy("row", "item").agg(F.count_if(~F.col("as_folded")).alias("framed"), F.count_if("as_folded").alias("folded"))
    return by_item.select("row", "item", F.when(F.col("framed") > 0, F.col("framed")).otherwise(F.col("folded")).alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: key, contaminated, n_windows, items (ascending ids of the benchmark items met)."""
    by_row = matches(docs, benchmark, key=key, text=text, **options).groupBy("row").agg(F.sum("n_windows").alias("n_windows"), F.array_sort(F.collect_set("item")).alias("items"))
    rows = docs.select(key, F.xxhash64(key, text).alias("row"))
    none = F.array().cast(by_row.schema["items"].dataType)
    return rows.join(by_row, "row", "left").select(key, F.col("n_windows").isNotNull().alias("contaminated"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"), F.coalesce("items", none).alias("items"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, that meet no benchmark item."""
    bad = matches(docs, benchmark, key=key, text=text, **options).select(F.col("row").alias(ROW)).distinct()
    return narrowed(docs.withColumn(ROW, F.xxhash64(key, text)), written(bad, "contaminated"), ROW, "left_anti").drop(ROW)
