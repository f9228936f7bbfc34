"""Structured Streaming twins of batch queries, run to the end of what is there (`availableNow`).

Each source is a folder of Parquet files; each result goes to a Parquet sink in
the checkpoint folder, so that the twin can be compared with its batch query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from lexloom.functions.text import held, ngrams, words
from lexloom.operators.shared import shared_dir, small


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stream of the table's files; its schema is read once from the batch side."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # as a glob, since a plain path to a single file would be taken for a folder of partitions
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


#: Files of each part of an arrival, and so of each micro-batch.
ARRIVAL_FILES = 2
#: The state store that operators with timers and lists need.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def arriving(rows: DataFrame, order: str, parts: int = 4) -> DataFrame:
    """A stream of the rows that come in `parts` micro-batches, by ranges of a column that is 0 or more."""
    spark, folder = rows.sparkSession, f"{_folder(rows.sparkSession)}/in"
    top = (rows.agg(F.max(order).alias("m")).first().m or 0) + 1
    for k in range(parts):
        inside = (F.col(order) * parts >= k * top) & (F.col(order) * parts < (k + 1) * top)
        rows.where(inside).repartition(ARRIVAL_FILES).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", ARRIVAL_FILES).parquet(folder)


def finished(stream: DataFrame, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Run the stream over all that is there and read its sink; `progress` gets what Spark reports of each micro-batch."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start()
        query.awaitTermination()
        if progress is not None:
            progress += query.recentProgress
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/ckpt").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def first_texts(docs: DataFrame, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Exact duplicates dropped by text hash. With an event-time column a hash is kept for `delay` only, so that the state is bounded; without one it is kept as long as the query runs, which suits `availableNow`."""
    hashed = docs.select(*([time] if time else []), F.sha2("text", 256).alias("h"))
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["h"]).select("h") if time else hashed.dropDuplicates(["h"])


def first_events(events: DataFrame, key: str = "event_id", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key. A key is forgotten `delay` after its time, and rows behind the watermark (of the micro-batch before) are dropped, so the state holds the keys of one delay."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def dropped_late(progress: list) -> int:
    """Rows that a finished query's operators dropped behind the watermark, by what Spark reported of its micro-batches."""
    return sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators)


class LateRows(StreamingQueryListener):
    """The same count of a query that runs on: after each micro-batch `alert` gets the query's name and its late rows so far, if there are any new ones."""

    def __init__(self, alert):
        self.alert, self.late = alert, {}

    def onQueryStarted(self, event):
        self.late[str(event.runId)] = 0

    def onQueryProgress(self, event):
        p, new = event.progress, dropped_late([event.progress])
        if new:
            self.late[str(p.runId)] = self.late.get(str(p.runId), 0) + new
            self.alert(p.name, self.late[str(p.runId)])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.late.pop(str(event.runId), None)


def _grams_of(docs: DataFrame, n: int) -> DataFrame:
    return held(docs.select("doc_id", "text"), "w", words(F.col("text"))).select("doc_id", F.explode(ngrams(F.col("w"), n)).alias("g"))


def contaminated(docs: DataFrame, grams: DataFrame, n: int = 13) -> DataFrame:
    """Stream of the ids of documents with a benchmark gram; the static side is broadcast if a count allows it."""
    return _grams_of(docs, n).join(small(grams), "g").select("doc_id").dropDuplicates(["doc_id"])


def without_contaminated(docs: DataFrame, grams: DataFrame, n: int = 13) -> DataFrame:
    """Stream of documents, all columns, without a benchmark gram. No state: a document's grams meet those of the
    benchmark as sorted 64-bit hashes, an array that is a constant of the plan and bounded by `MOST_GRAMS`."""
    known = grams.select(F.xxhash64("g").alias("h")).distinct().limit(MOST_GRAMS + 1).collect()
    if len(known) > MOST_GRAMS:
        raise ValueError(f"more than {MOST_GRAMS} grams: filter in batches with operators.contamination")
    hashes = F.array(*[F.lit(r.h) for r in known]).cast("array<bigint>")
    w = held(docs, "__w", words(F.col("text")))
    hit = F.arrays_overlap(F.transform(ngrams(F.col("__w"), n), lambda g: F.xxhash64(g)), hashes)
    return w.where(~F.coalesce(hit, F.lit(False))).drop("__w")


#: Benchmark grams that a streaming plan carries as a constant at most.
MOST_GRAMS = 100_000


def health_alerts(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Alerts by window of event time: a value ten times the window's mean, a value that is not finite, a kind of event that is missing."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    g = e.groupBy(F.window("ts", width).alias("w")).agg(
        F.count("*").alias("n"), (F.max("value") > 10 * F.avg("value")).alias("spike"), (F.max(bad.cast("int")) == 1).alias("non_finite"), (F.size(F.collect_set("event_type")) < 5).alias("missing_kind"),
    )
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "spike", "non_finite", "missing_kind")
