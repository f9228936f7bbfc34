"""Training rows from conversations: ids and labels, packing, padding, and a loader whose state can be resumed.

Sequential rules (next-fit packing) run over ranges of `SHARD` ids, one ordered
range a task in time linear in its rows; everything else is by prefix sums and
distributed ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from lexloom.operators.prefix import ranked

#: Bytes are their own ids, then come the markers; masked labels.
MARKERS, END, MASKED = {"user": 256, "assistant": 257, "system": 258}, 259, -100
MODES = ("correct", "no_eos", "no_mask", "last_turn")
#: Width of a packing range, in ids.
SHARD = 100_000


def byte_ids(text: Column) -> Column:
    """The UTF-8 bytes of a text as integers; empty for null and empty texts."""
    raw = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    one = lambda i: F.conv(F.substring(raw, F.lit(2) * i + 1, F.lit(2)), 16, 10).cast("int")
    return F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), one)).otherwise(F.array().cast("array<int>"))


def decoded(ids: Column) -> Column:
    """The text of byte ids; markers are left out."""
    raw = F.array_join(F.transform(F.filter(ids, lambda x: x < 256), lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
    return F.decode(F.unhex(raw), "UTF-8")


def examples(turns: DataFrame, mode: str = "correct", limit: int | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", generation_prompt: bool = False) -> DataFrame:
    """conv, ids, labels: a marker and the bytes of each turn, END after the assistant's; labels are ids where the mode supervises and MASKED elsewhere.

    correct: the assistant's bytes and END; no_eos: bytes alone; no_mask: everything;
    last_turn: bytes and END of the last assistant turn. Other roles take the user's
    marker. Rows are cut to `limit` ids. With `generation_prompt` an assistant marker
    ends the ids, masked.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    marker = F.coalesce(*[F.when(F.col(role) == k, F.lit(v)) for k, v in MARKERS.items()], F.lit(MARKERS["user"]))
    is_a = F.coalesce(F.col(role) == "assistant", F.lit(False))
    end = F.when(is_a, F.array(F.lit(END))).otherwise(F.array().cast("array<int>"))
    rows = turns.select(F.col(conv).alias("conv"), F.struct(F.col(turn).alias("turn"), is_a.alias("a"), F.array(marker).alias("m"), byte_ids(F.col(text)).alias("b"), end.alias("e")).alias("t"))
    one = rows.groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    last = F.array_max(F.transform(F.filter("ts", lambda t: t["a"]), lambda t: t["turn"]))
    masked = lambda x: F.transform(x, lambda _: F.lit(MASKED))

    def labels(t: Column) -> Column:
        if mode == "no_mask":
            return F.concat(t["m"], t["b"], t["e"])
        on = t["a"] if mode != "last_turn" else t["a"] & (t["turn"] == last)
        after = masked(t["e"]) if mode == "no_eos" else F.when(on, t["e"]).otherwise(masked(t["e"]))
        return F.concat(masked(t["m"]), F.when(on, t["b"]).otherwise(masked(t["b"])), after)

    ids, lab = F.flatten(F.transform("ts", lambda t: F.concat(t["m"], t["b"], t["e"]))), F.flatten(F.transform("ts", labels))
    if generation_prompt:
        ids, lab = F.concat(ids, F.array(F.lit(MARKERS["assistant"]))), F.concat(lab, F.array(F.lit(MASKED)))
    cut = lambda x: F.slice(x, 1, limit) if limit else x
    return one.select(F.col("conv").alias(conv), cut(ids).alias("ids"), cut(lab).alias("labels"))


def padded(rows: DataFrame, key: str, batch: int, pad: int = 0) -> DataFrame:
    """rows (key, ids, labels) in batches of the key's order -> + batch, longest, and ids and labels filled to the batch's longest."""
    sized = ranked(rows.withColumn("n", F.size("ids")), key, key, "place").withColumn("batch", F.floor((F.col("place") - 1) / batch))
    longest = sized.groupBy("batch").agg(F.max("n").alias("longest"))
    fill = lambda x, v: F.concat(F.col(x), F.array_repeat(F.lit(v), F.col("longest") - F.col("n")))
    return sized.join(longest, "batch").withColumns({"ids": fill("ids", pad), "labels": fill("labels", MASKED)}).drop("place")


def padding_waste(lengths: DataFrame, key: str, n: str, batch: int) -> DataFrame:
    """batch, longest, padded, useful, share."""
    b = ranked(lengths, key, key, "place").withColumn("batch", F.floor((F.col("place") - 1) / batch))
    g = b.groupBy("batch").agg(F.max(n).alias("longest"), (F.max(n) * F.count("*")).alias("padded"), F.sum(n).alias("useful"))
    return g.withColumn("share", F.col("useful") / F.col("padded"))


class NextFit:
    """A table function: rows of (shard, key, n) stream through in the order of their keys; shards are sequences of their own."""

    def __init__(self):
        self.pack = self.used = 0

    @staticmethod
    def analyze(rows: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        if not {"shard", "key", "n"} <= kinds.keys():
            raise ValueError("next_fit takes a table with the columns shard, key and n")
        out = StructType().add("shard", LongType()).add("key", kinds["key"]).add("pack", LongType()).add("start_at", LongType())
        return AnalyzeResult(out, partitionBy=[PartitioningColumn("shard")], orderBy=[OrderingColumn("key"), OrderingColumn("n")])

    def eval(self, rows, limit):
        if rows["n"] is None or rows["n"] > limit:
            return
        if self.used and self.used + rows["n"] > limit:
            self.pack, self.used = self.pack + 1, 0
        yield rows["shard"], rows["key"], self.pack, self.used
        self.used += rows["n"]


def next_fit(lengths: DataFrame, key: str, n: str, limit: int, shard: int = SHARD) -> DataFrame:
    """shard, key, pack, start_at: in the key's order each row goes to the open pack or, if it does not fit, opens the next; rows over the limit or without a length are left out.

    Ranges of `shard` ids are sequences of their own; within one, rows stream through a table function, and none is held.
    """
    rows = lengths.select(F.floor(F.col(key) / shard).alias("shard"), F.col(key).alias("key"), F.col(n).cast("long").alias("n"))
    return udtf(NextFit)(rows.asTable(), F.lit(limit)).withColumnRenamed("key", key)


def batches(docs: DataFrame, key: str, epoch: int, batch: int, seed: int, after: int = -1) -> DataFrame:
    """epoch, step, key: the loader's batches of one epoch in the order of a hash of (seed, epoch, key), the incomplete last one left out; with `after`, those behind a saved step."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-{epoch}-"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("long")
    rows = docs.select(key, h.alias("__h"))
    n = rows.count()
    placed = ranked(rows, "__h", key, "__place").where(F.col("__place") <= n // batch * batch)
    return placed.select(F.lit(epoch).cast("long").alias("epoch"), F.floor((F.col("__place") - 1) / batch).alias("step"), key).where(F.col("step") > after)


class Loader:
    """Batches epoch by epoch; its state is a dictionary that a later loader takes up."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", batch: int = 32, seed: int = 7):
        self.docs, self.key, self.batch, self.seed, self.epoch, self.step = docs, key, batch, seed, 0, -1
        self.steps = docs.count() // batch

    def state_dict(self) -> dict[str, int]:
        return {"seed": self.seed, "batch": self.batch, "epoch": self.epoch, "step": self.step}

    def load_state_dict(self, state: dict[str, int]) -> None:
        if (state["seed"], state["batch"]) != (self.seed, self.batch):
            raise ValueError("the state is of another seed or batch size")
        self.epoch, self.step = state["epoch"], state["step"]

    def next(self, steps: int) -> DataFrame:
        """The next batches, on into the epochs that follow."""
        out, left = None, steps
        while left > 0 and self.steps:
            if self.step + 1 >= self.steps:
                self.epoch, self.step = self.epoch + 1, -1
            take = min(left, self.steps - self.step - 1)
            part = batches(self.docs, self.key, self.epoch, self.batch, self.seed, self.step).where(F.col("step") <= self.step + take)
            out = part if out is None else out.union(part)
            self.step, left = self.step + take, left - take
        return batches(self.docs.limit(0), self.key, 0, self.batch, self.seed) if out is None else out


def first_difference(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """steps, differing, first_epoch, first_step (null if all agree): two runs compared batch by batch, by two hashes of a batch's rows."""
    digest = lambda x, name: x.groupBy("epoch", "step").agg(F.count("*").alias(name + "n"), F.bit_xor(F.xxhash64(key)).alias(name + "h"))
    m = digest(a, "a").join(digest(b, "b"), ["epoch", "step"], "full").withColumn("differs", ~(F.col("an").eqNullSafe(F.col("bn")) & F.col("ah").eqNullSafe(F.col("bh"))))
    first = F.min(F.when(F.col("differs"), F.struct("epoch", "step")))
    return m.agg(F.count("*").alias("steps"), F.count_if("differs").alias("differing"), first.alias("f")).select("steps", "differing", F.col("f.epoch").alias("first_epoch"), F.col("f.step").alias("first_step"))
