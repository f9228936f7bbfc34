"""Stage outputs that can be repeated: versioned folders, written once, with statistics beside them; and shards for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Stages:
    """Outputs below one folder of a store that driver and executors share: `<base>/<stage>/version=<v>/` beside `<base>/_statistics/`."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def path(self, stage: str, version: str) -> str:
        return f"{self.base}/{stage}/version={version}"

    def done(self, stage: str, version: str) -> bool:
        """Whether the stage's statistics, which are written last, are there."""
        return self._exists(f"{self.base}/_statistics/{stage}/version={version}/_SUCCESS")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def write(self, stage: str, version: str, df: DataFrame, **measures: Column) -> DataFrame:
        """Write the stage unless this version is complete, and read it; a half-written version is replaced.

        Rows and `measures` (aggregates) are taken of what was written, by the columns they need. An Observation
        would save that pass, but leaves the session in a state that Spark's own models cannot serialise.
        """
        if not self.done(stage, version):
            df.write.mode("overwrite").parquet(self.path(stage, version))
            written = self.spark.read.schema(df.schema).parquet(self.path(stage, version))
            seen = written.agg(F.count(F.lit(1)).alias("n_rows"), *[c.alias(k) for k, c in measures.items()]).first().asDict()
            values = {k: None if v is None else float(v) for k, v in seen.items()}
            rows = self.spark.createDataFrame(list(values.items()), "name string, value double")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.base}/_statistics/{stage}/version={version}")
        return self.spark.read.schema(df.schema).parquet(self.path(stage, version))

    def statistics(self, stage: str, version: str) -> DataFrame:
        return self.spark.read.schema("name string, value double").parquet(f"{self.base}/_statistics/{stage}/version={version}")


def shard_of(key: Column, shards: int) -> Column:
    """A shard from the first 32 bits of an md5 of the key, the same in other engines."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def write_shards(df: DataFrame, folder: str, key: str, shards: int, rows_a_file: int = 1_000_000) -> DataFrame:
    """Rows shuffled once, in the order of a second hash, into `shard=<k>` folders for ranks to read in sequence; a shard's files hold at most `rows_a_file` rows."""
    dealt = df.withColumns({"shard": shard_of(F.col(key), shards), "__order": F.xxhash64(key)})
    ordered = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "__order").drop("__order")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(folder)
    return df.sparkSession.read.parquet(folder)
