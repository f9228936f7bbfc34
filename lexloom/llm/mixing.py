"""Operator 6: mixing sources to target weights.

Every document gets a hash-random key. Within each source the documents stand
in the order of their keys; a distributed prefix sum of their sizes (sums of
key ranges, then running sums inside each range) tells where the source's
budget ends. A budget of several epochs takes every document that many times
and cuts the last epoch at the exact word. Only (id, source, size) is shuffled,
and no task holds more than one range of one source.

Defined results: null text has size 0; a null source is a source of its own,
the last; sources without words have target 0. Rows with the same id are told
apart by a second hash over their text, and whole repeated rows get equal keys
in an order that does not matter, as they are alike. Rows without an id get keys by
their text and place in the input. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one key range of a source holds on average.
RANGE_ROWS = 2_000
MAX_SHARE = 3.0
#: The list of sources is broadcast up to this length and joined by shuffle beyond it.
BROADCAST_SOURCES = 10_000
CYCLE = (1, 2, 3)


def targets(sizes: DataFrame, cap: float = MAX_SHARE) -> DataFrame:
    """source, n_docs, source_size -> + target: weights in turn, capped, the excess shared again among the rest.

    Capped sources are those of the largest weight per word; in that order the
    level is where what is left over the weights left no longer passes the cap.
    One row a source, so the windows here are over the list of sources.
    """
    everything = Window.partitionBy(F.lit(0))
    s = sizes.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("rank") % len(CYCLE) + 1).cast("int")).cast("double"))
    most = F.col("source_size") * cap
    order = everything.orderBy(F.when(most > 0, F.col("weight") / most).desc_nulls_first(), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.sum("weight").over(after))  # words a weight gets if all before are capped
    s = s.withColumn("is_capped", F.col("level") * F.col("weight") > most)
    # the first source in this order that is not over its cap ends the capping
    level = F.first(F.when(~F.col("is_capped"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.withColumn("target", F.least(most, level * F.col("weight"))).select("source", "n_docs", "source_size", "target")


#: A column name that no input has.
ROW = "__lexloom_row"


def mix(df: DataFrame, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text", cap: float = MAX_SHARE, row: str | None = None) -> DataFrame:
    """Per row: key, size, source, source_size, target, taken (words of it in the mix, repeats counted), and the column `row` if one is named."""
    alone = F.concat_ws("/", F.lit("none"), F.xxhash64(text).cast("string"), (F.col(row) if row else F.monotonically_increasing_id()).cast("string"))
    rows = written(
        df.select(
            (F.col(row) if row else F.lit(None).cast("long")).alias("row"), F.col(key).alias("id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            # the first 32 bits of an md5, which other engines have, too; then a second hash that tells texts of one id apart.
            # Rows without an id have keys by their text and place, so that they are not one range
            F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), alone))), 1, 8), 16, 10).cast("long").alias("k"),
            F.xxhash64(text).alias("k2"),
        ),
        "mix",
    )
    sizes = rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    plan = written(targets(sizes, cap).withColumn("n_ranges", F.ceil(F.col("n_docs") / RANGE_ROWS).cast("long")), "mix-plan")
    side = F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan
    # A key range is a slice of the hash's values, so ranges are even and in the keys' order.
    slot = F.floor(F.col("k") * F.col("n_ranges") / F.lit(float(1 << 32)))
    same = F.expr("a.source <=> b.source")
    ranged = rows.alias("a").join(side.alias("b"), same).select("row", "id", "k", "k2", "size", "a.source", "source_size", "target", "n_docs", slot.alias("slot"))
    sums = ranged.groupBy("source", "slot").agg(F.sum("size").alias("slot_size"))
    by_source = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before_slot", F.coalesce(F.sum("slot_size").over(by_source), F.lit(0))).drop("slot_size")
    inside = Window.partitionBy("source", "slot").orderBy("k", "id", "k2", "row").rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    same = F.expr("r.source <=> s.source and r.slot = s.slot")
    run = run.alias("r").join(sums.alias("s"), same).select("r.*", (F.col("before") + F.col("before_slot")).alias("start"))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    cut = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), cut - F.col("start")))
    return run.select(*([F.col("row").alias(row)] if row else []), F.col("id").alias(key), "size", "source", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of `df` that the mix takes, all columns, with size, source_size, target and taken; columns of these names are replaced.

    Rows are numbered in a written table, so that each gets its own part, whatever its id.
    """
    rows = written(df.drop("size", "source_size", "target", "taken").withColumn(ROW, F.monotonically_increasing_id()), "mix-rows")
    plan = mix(rows, row=ROW, **options).where("taken > 0").select(ROW, "size", "source_size", "target", "taken")
    return rows.join(plan.hint("shuffle_hash"), ROW).drop(ROW)
