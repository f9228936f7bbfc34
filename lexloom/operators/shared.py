"""Tables in the folder that driver and executors share: they cut lineage, so that a lost executor costs nothing before them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: With this on, a query's shuffle files go when it ends, not when the driver happens to collect its plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of 8 to 16 bytes that are broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not jsc.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lexloom-')}")
    return jsc.getCheckpointDir().get().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of the shared folder; `freed` deletes it."""
    spark = df.sparkSession
    path, before = f"{shared_dir(spark)}/lexloom-{uuid.uuid4().hex}", spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._lexloom_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame) -> DataFrame:
    """The table marked for broadcast if a count finds at most BROADCAST_ROWS rows; as it is otherwise."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
