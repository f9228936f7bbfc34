"""Distributed prefix sums and ranks: sums of ranges first, then running sums inside each range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = 10_000
#: Ranges that a ranking cuts its values into.
PARTS = 64


def running_sum(df: DataFrame, key: str, value: str, out: str, width: int = RANGE) -> DataFrame:
    """`out`: the sum of `value` over all smaller integer keys; only one row a range meets in the window over ranges.

    Null keys come last, equal keys by value.
    """
    ranged = df.withColumn("__range", F.floor(F.col(key) / width))
    sums = ranged.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = sums.select(F.col("__range").alias("__of"), (F.sum("__sum").over(Window.orderBy(F.asc_nulls_last("__range"))) - F.col("__sum")).alias("__before"))
    inside = Window.partitionBy("__range").orderBy(key, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranged.withColumn("__in", F.sum(value).over(inside) - F.col(value)).join(before, F.col("__range").eqNullSafe(F.col("__of"))).withColumn(out, F.col("__in") + F.col("__before")).drop("__range", "__of", "__in", "__before")


def ranked(df: DataFrame, value: str, tie: str, out: str, descending: bool = False, parts: int = PARTS, width: int = RANGE) -> DataFrame:
    """`out`: the place of each row, from 1, by a numeric `value` and then by an integer `tie`, without a task that orders all rows.

    Values are cut at quantiles; a value that fills whole ranges is cut again by
    ranges of `tie`. Where the cuts are changes the balance only, never a place.
    Nulls come last.
    """
    v = -F.col(value).cast("double") if descending else F.col(value).cast("double")
    cuts = df.agg(F.percentile_approx(v, [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    often = sorted({c for c in cuts if cuts.count(c) > 1})
    cut, hot = (F.array(*map(F.lit, x)).cast("array<double>") for x in (cuts, often))
    below = F.size(F.filter(cut, lambda c: c < v))
    is_hot = F.array_contains(hot, v) if often else F.lit(False)
    part = F.when(v.isNull(), 2 * parts + 2).otherwise(2 * below + is_hot.cast("int"))
    placed = df.withColumns({"__part": part, "__range": F.when(v.isNull() | is_hot, F.floor(F.col(tie) / width)).otherwise(F.lit(0).cast("long")), "__v": v})
    sums = placed.groupBy("__part", "__range").agg(F.count("*").alias("__n"))
    order = Window.orderBy("__part", F.asc_nulls_last("__range")).rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = sums.select(F.col("__part").alias("__p"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", "__range").orderBy(F.asc_nulls_last("__v"), F.asc_nulls_last(tie))
    same = (F.col("__part") == F.col("__p")) & F.col("__range").eqNullSafe(F.col("__r"))
    return placed.withColumn("__in", F.row_number().over(inside)).join(before, same).withColumn(out, F.col("__in") + F.col("__before")).drop("__part", "__range", "__v", "__p", "__r", "__in", "__before")


def tiled(place: Column, total: Column, tiles: int) -> Column:
    """The tile (from 1) of a place among `total`, as ntile deals: the first tiles are one longer."""
    size, longer = F.floor(total / tiles), total % tiles
    return F.when(place <= longer * (size + 1), F.ceil(place / (size + 1))).otherwise(longer + F.ceil((place - longer * (size + 1)) / F.greatest(size, F.lit(1)))).cast("long")
