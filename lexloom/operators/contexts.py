"""Long prompts cut from a corpus, needles put into them, and mixes made by repeating documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import md5_bucket, ws_words
from lexloom.operators.prefix import running_sum


def contexts(docs: DataFrame, lengths: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """length, context, words: the corpus' words in the order of the key, cut every `length` words; the incomplete last context is left out.

    Where a text begins is a distributed prefix sum; each text then sends every
    context its own slice, so a context is the only thing held whole. Null texts have no words.
    """
    w = docs.select(key, F.coalesce(ws_words(F.col(text)), F.array().cast("array<string>")).alias("w"))
    starts = running_sum(w.select(key, F.size("w").cast("long").alias("n")), key, "n", "start").where("n > 0")
    placed = w.join(starts, key).select("w", "n", "start", F.explode(F.array(*[F.lit(n).cast("long") for n in lengths])).alias("length"))
    touched = F.expr("sequence(start div length, (start + n - 1) div length)")
    each = placed.select("w", "n", "start", "length", F.explode(touched).alias("context"))
    first = F.greatest(F.col("context") * F.col("length"), F.col("start"))
    last = F.least((F.col("context") + 1) * F.col("length"), F.col("start") + F.col("n"))
    part = F.slice("w", (first - F.col("start") + 1).cast("int"), (last - first).cast("int"))
    grouped = each.select("length", "context", F.struct(first.alias("at"), part.alias("w")).alias("p")).groupBy("length", "context").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    out = grouped.select("length", "context", F.flatten(F.transform("ps", lambda p: p["w"])).alias("words"))
    return out.where(F.size("words") == F.col("length"))


def needled(found: DataFrame, needle: Column, fractions: list[float]) -> DataFrame:
    """length, context, fraction, at, prompt: each context with the needle (one element) put in after a fraction of its words."""
    each = found.select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"))
    each = each.withColumn("at", F.floor(F.col("length") * F.col("fraction")).cast("int"))
    return each.select("length", "context", "fraction", "at", F.array_insert("words", F.col("at") + 1, needle).alias("prompt"))


def searched(prompts: DataFrame, needle: Column, window: int) -> DataFrame:
    """+ found, right: the needle's place from 1 as a reader of the last `window` elements finds it (0: not at all), and whether it is where it was put."""
    skipped = F.greatest(F.size("prompt") - window, F.lit(0))
    seen = F.array_position(F.slice("prompt", skipped + 1, F.lit(window)), needle)
    found = F.when(seen > 0, seen + skipped).otherwise(0)
    return prompts.select("*", found.cast("long").alias("found")).withColumn("right", F.col("found") == F.col("at") + 1)


def heat_map(judged: DataFrame, fractions: list[float]) -> DataFrame:
    """length, and a column for each fraction (p0 to p100): the share of prompts whose needle was found."""
    named = judged.withColumn("p", F.concat(F.lit("p"), F.round(F.col("fraction") * 100).cast("int").cast("string")))
    return named.groupBy("length").pivot("p", [f"p{round(100 * f)}" for f in fractions]).agg(F.avg(F.col("right").cast("double")))


#: Slices of the hash order of one source whose sums are formed first.
SLICES_LOG2 = 14


def replicated(docs: DataFrame, plan: DataFrame, size: str, key: str = "doc_id", source: str = "source") -> DataFrame:
    """key, source, size, epoch (from 1): documents repeated so that each source comes to its `target` in `plan` (source, target), less than one document over.

    A source gives whole epochs first; of the last, documents in the order of a
    hash of the key until the target is reached. Sources without a target or
    without words give nothing. Sums are taken of slices of the hash order, then inside a slice.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"), md5_bucket(F.col(key).cast("string")).alias("h"))
    rows = rows.withColumn("slice", F.shiftright("h", 32 - SLICES_LOG2))
    sums = rows.groupBy("source", "slice").agg(F.sum("size").alias("s"))
    by = Window.partitionBy("source").orderBy(F.asc_nulls_last("slice"))
    before = sums.select(F.col("source").alias("s1"), F.col("slice").alias("s2"), (F.sum("s").over(by) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy("source")).alias("available"))
    inside = Window.partitionBy("source", "slice").orderBy("h", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(before, F.col("source").eqNullSafe(F.col("s1")) & F.col("slice").eqNullSafe(F.col("s2")))
    goal = plan.select(F.col("source").alias("s3"), F.col("target"))
    met = placed.join(goal, F.col("source").eqNullSafe(F.col("s3"))).where("available > 0 and target > 0")
    epochs = F.floor(F.col("target") / F.col("available"))
    more = F.col("before") + F.col("inside") < F.col("target") - epochs * F.col("available")
    copies = (epochs + more.cast("int")).cast("int")
    chosen = met.select("key", "source", "size", copies.alias("copies")).where("copies > 0")
    return chosen.select(F.col("key").alias(key), F.col("source").alias(source), F.col("size").alias(size), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("epoch"))
