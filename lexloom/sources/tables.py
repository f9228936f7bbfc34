"""Reading the driver tables; a path is only ever opened by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
#: Tables of long texts, whose rows cost enough to be dealt to all cores.
TEXTS = ("documents", "pages")


#: Tables under so many bytes on disk are dealt to all cores; larger ones are never shuffled by their reader.
SPREAD_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small table dealt evenly where its scan has fewer splits than the session has cores: a file of one row group
    is one task's, however many cores there are. What this shuffles is bounded by SPREAD_BYTES, on any cluster."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SPREAD_BYTES and df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if name in TEXTS else df
