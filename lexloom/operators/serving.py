"""Serving simulations: requests refill slots in order of arrival; a paged cache grows by blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width, in request ids, of one server's queue.
QUEUE = 1 << 20


def schedule(requests: DataFrame, key: str, length: str, slots: int, queue: int = QUEUE) -> DataFrame:
    """server, key, start, stop: each request starts when the first of its server's slots is free.

    The rule is sequential, so a task runs one queue, `queue` ids wide, with a heap of
    slots; queues are servers of their own.
    """
    kind = requests.schema[key].dataType.simpleString()

    def run(frame):
        import heapq

        import pandas as pd

        frame = frame.sort_values("key")
        free, start = [0] * slots, []
        for n in frame["n"]:
            at = free[0]
            heapq.heapreplace(free, at + n)
            start.append(at)
        return pd.DataFrame({"server": frame["server"], "key": frame["key"], "start": start, "stop": [a + n for a, n in zip(start, frame["n"], strict=True)]})

    rows = requests.select(F.floor(F.col(key) / queue).alias("server"), F.col(key).alias("key"), F.col(length).cast("long").alias("n"))
    return rows.groupBy("server").applyInPandas(run, f"server long, key {kind}, start long, stop long").withColumnRenamed("key", key)


def utilisation(scheduled: DataFrame, slots: int) -> DataFrame:
    """server, iterations, useful, utilisation."""
    g = scheduled.groupBy("server").agg(F.max("stop").alias("iterations"), F.sum(F.col("stop") - F.col("start")).alias("useful"))
    return g.withColumn("utilisation", F.col("useful") / (F.col("iterations") * slots))


def peak_blocks(scheduled: DataFrame, prompts: DataFrame, key: str, prompt: str, block: int) -> DataFrame:
    """server, peak_blocks: the most cache blocks held at one iteration. A request's blocks grow by one at a time, so it is a few changes, not a row an iteration."""
    r = scheduled.join(prompts.select(key, F.col(prompt).cast("long").alias("p")), key)
    blocks = lambda n: F.greatest(F.lit(1).cast("long"), F.floor((n + (block - 1)) / block))
    first = F.struct(F.col("start").alias("t"), blocks(F.col("p")).alias("d"))
    total = F.col("stop") - F.col("start")
    held = blocks(F.col("p") + total - 1)
    # one more block at each iteration whose length passes a multiple of the block
    more = F.transform(
        F.when(held > blocks(F.col("p")), F.sequence(blocks(F.col("p")), held - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda k: F.struct((F.col("start") + k * block + 1 - F.col("p")).alias("t"), F.lit(1).cast("long").alias("d")),
    )
    last = F.struct(F.col("stop").alias("t"), (-held).alias("d"))
    changes = r.select("server", F.inline(F.concat(F.array(first), more, F.array(last)))).groupBy("server", "t").agg(F.sum("d").alias("d"))
    run = F.sum("d").over(Window.partitionBy("server").orderBy("t"))  # one row an iteration with a change, of one queue
    return changes.withColumn("held", run).groupBy("server").agg(F.max("held").alias("peak_blocks"))


def share_counts(uses: DataFrame, block: str, start: str, stop: str) -> DataFrame:
    """block, peak, left: the most holders a shared block has at one time, and those that remain; a block goes when the last lets go. A block's changes are one group."""
    e = uses.select(block, F.inline(F.array(F.struct(F.col(start).alias("t"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("t"), F.lit(-1).alias("d"))))).groupBy(block, "t").agg(F.sum("d").alias("d"))
    run = F.sum("d").over(Window.partitionBy(block).orderBy("t"))
    return e.withColumn("refs", run).groupBy(block).agg(F.max("refs").alias("peak"), F.max_by("refs", "t").alias("left"))
