"""Nearest vectors of a query set among all rows, in blocks of queries by blocks of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.shared import written

#: Queries of a block at most; a task holds one block of them.
BLOCK = 4096
#: Rows and queries that are multiplied at once (4 MB of products); a block has ROWS rows.
ROWS, QUERIES = 4096, 128
#: Blocks of rows that a task sees: it sends k rows a query for all of them together.
SEEN = 32


def largest(dot: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of each row's k largest values, of equal ones the first, and the values; they are struck out of `dot`, so what a row lacks is -inf."""
    rows, places, values = np.arange(len(dot)), [], []
    for _ in range(min(k, dot.shape[1])):
        places.append(dot.argmax(axis=1))
        values.append(dot[rows, places[-1]])
        dot[rows, places[-1]] = -np.inf
    return np.stack(places, axis=1), np.stack(values, axis=1)


def merged(best, row: np.ndarray, value: np.ndarray, name: np.ndarray) -> None:
    """Put (row, value, name) into `best`, (values, names) of the k best of each row in order; of equal values the smaller name is first."""
    values, names = best
    k, some = values.shape[1], np.unique(row)
    row = np.concatenate([np.repeat(some, k), row])
    value, name = np.concatenate([values[some].ravel(), value]), np.concatenate([names[some].ravel(), name])
    order = np.lexsort((name, -value, row))
    row = row[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    order = order[first[:, None] + np.arange(k)]  # each row has its k old ones at least
    values[some], names[some] = value[order], name[order]


def meet(best, a: np.ndarray, q: np.ndarray, b: np.ndarray, x: np.ndarray) -> None:
    """Bring the rows (b, x), in the order of b, into the k best of each of the queries (a, q)."""
    k = best[0].shape[1]
    for at in range(0, len(a), QUERIES):
        now = tuple(v[at : at + QUERIES] for v in best)
        dot = q[at : at + QUERIES] @ x.T
        lo, hi = (np.searchsorted(b, a[at : at + QUERIES], side) for side in ("left", "right"))
        for i in np.flatnonzero(hi > lo):
            dot[i, lo[i] : hi[i]] = -np.inf  # the query itself
        least = now[0][:, -1:]
        likely = dot >= least - 1e-6  # what may be as much as the least of the k once it is rounded
        if np.isinf(least).any() or np.count_nonzero(likely) > 16 * k * len(dot):  # at first, or many equal ones
            top, value = largest(np.round(dot, 6), k)
            row, value, name = np.repeat(np.arange(len(dot)), top.shape[1]), value.ravel(), b[top.ravel()]
        else:
            row, place = np.divmod(np.flatnonzero(likely), dot.shape[1])  # several times as fast as nonzero of two dimensions
            value, name = np.round(dot[row, place], 6), b[place]
        if len(row):
            merged(now, row, value, name)


def packed(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """block, names, vectors: `size` rows at a time, by key, as bytes."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def out(names, xs):
            names, x = np.concatenate(names), np.concatenate(xs)
            order = np.argsort(names, kind="stable")
            row = ((TaskContext.get().partitionId() << 32) + made, names[order].tobytes(), x[order].tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "names", "vectors"])

        names, xs, n, made = [], [], 0, 0
        for whole in batches:
            lo = 0
            while lo < whole.num_rows:
                b = whole.slice(lo, size - n)
                names.append(b.column(key).to_numpy().astype(np.int64))
                xs.append(b.column(vector).flatten().to_numpy().reshape(b.num_rows, -1))
                lo, n = lo + b.num_rows, n + b.num_rows
                if n == size:
                    yield out(names, xs)
                    names, xs, n, made = [], [], 0, made + 1
        if n:
            yield out(names, xs)

    return rows.select(key, vector).where(F.col(key).isNotNull()).mapInArrow(run, "block long, names binary, vectors binary")


def dealt(blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """Blocks in partitions of their own, or evenly in so many."""
    ids = sorted(r.block for r in blocks.select("block").collect())
    parts = parts or len(ids)
    place = blocks.sparkSession.createDataFrame([(v, i % parts) for i, v in enumerate(ids)], "block long, place int")
    return blocks.join(F.broadcast(place), "block").repartitionById(parts, "place").drop("place")


def nearest(table: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = BLOCK) -> DataFrame:
    """(a, b, dot): the k rows of `table` of the largest inner product with each query, the query itself left out; ties go to the smaller key.

    Queries and rows are packed into blocks; a task takes one block of queries and SEEN blocks of rows, by a product of both tables
    without shuffle, and keeps k a query. The driver has the blocks' numbers only.
    """
    spark = table.sparkSession
    kind = {"float": np.float32, "double": np.float64}[table.schema[vector].dataType.elementType.simpleString()]
    cores, n = spark.sparkContext.defaultParallelism, queries.count()
    size = max(1, min(block, -(-n // (2 * cores))))  # of a small table also blocks enough for all cores
    left, right = written(packed(queries, key, vector, size)), written(packed(table, key, vector, ROWS))
    every = right.count()
    if not n or not every:
        return spark.createDataFrame([], "a long, b long, dot double")
    left, right = dealt(left).select("block", F.col("names").alias("a"), F.col("vectors").alias("q")), dealt(right, -(-every // SEEN)).select("names", "vectors")

    def run(batches):
        import pyarrow as pa

        def vectors(raw, n):
            return np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64)

        def out():
            held = np.isfinite(best[0])
            columns = (np.broadcast_to(a[:, None], held.shape)[held], best[1][held], best[0][held])
            return pa.RecordBatch.from_arrays([pa.array(v) for v in columns], ["a", "b", "dot"])

        last, a, q, best = None, None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at, names, qs, others, xs = (batch.column(c)[i].as_py() for c in ("block", "a", "q", "names", "vectors"))
                if at != last:
                    if last is not None:
                        yield out()
                    last, a = at, np.frombuffer(names, np.int64)
                    q, best = vectors(qs, len(a)), (np.full((len(a), k), -np.inf), np.zeros((len(a), k), np.int64))
                b = np.frombuffer(others, np.int64)
                meet(best, a, q, b, vectors(xs, len(b)))
        if last is not None:
            yield out()

    found = left.join(right.hint("shuffle_replicate_nl")).mapInArrow(run, "a long, b long, dot double")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("dot"), "b"))
    return found.withColumn("rn", place).where(F.col("rn") <= k).drop("rn")
