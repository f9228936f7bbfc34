"""What the operators share: reading tables, Arrow mapping, and writes to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from lexloom.sources.tables import table  # noqa: F401 (the queries and the pipeline read by it)

#: The five ASCII control spaces and the blank; `bytes.split()` splits at exactly these.
SPACES = " \t\n\x0b\x0c\r"


def map_batches(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Arrow map: `fn` gets the columns of a batch as Python lists and returns columns by name.

    The session's Arrow batch limits bound what one call holds.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                out = fn(b.slice(at, ROWS).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(frugal(run), schema)


#: Rows that one call of a batch function gets at most.
ROWS = 512


def frugal(run: Callable) -> Callable:
    """A batch function whose worker gives freed memory back to the system when it ends, as workers stay for later tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes

            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, one of our own in local mode, as in tests; elsewhere an error, as executors do not share a local folder."""
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


#: Settings while a table is written: a query's shuffle files go when it ends, not when the driver happens to collect its
#: plan, and Arrow batches are small, as the JVM keeps the buffers of the largest.
WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage is cut and lost executors cost nothing before it.

    The shuffle files that made the table go with the query; `freed` deletes the table itself.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/lexloom-{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WHILE_WRITING}
    try:
        for k, v in WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._lexloom_path = path
    return out


def freed(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._lexloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Ids (about 100 bytes each in a hash table) that are broadcast at most; more are joined by shuffle.
BROADCAST_IDS = 500_000


def narrowed(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """The rows of `df` whose key is (or, for left_anti, is not) among `ids`; the ids are broadcast only after a count of them."""
    from pyspark.sql import functions as F

    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)
