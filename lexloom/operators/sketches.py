"""Approximate distinct counts that merge: sketches kept as binary columns, united and intersected later without the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.bloom import ngram_hashes

#: HyperLogLog of 2^15 registers (standard error 0.6 %), theta sketches of 2^15 values (0.6 % of a union).
HLL_LOG2, THETA_LOG2 = 15, 15


def ngram_sketches(docs: DataFrame, by: list[str], n: int = 5, text: str = "text") -> DataFrame:
    """by, hll, theta, n_rows: a group's distinct n-grams as two sketches, combined on the map side. Groups whose texts have no n-gram are left out."""
    each = ngram_hashes(docs, n, text, tuple(by)).select(*by, F.explode("hs").alias("h"))
    return each.groupBy(*by).agg(F.hll_sketch_agg("h", HLL_LOG2).alias("hll"), F.theta_sketch_agg("h", THETA_LOG2).alias("theta"), F.count("*").alias("n_rows"))


def rolled_up(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The sketches of larger groups from those of smaller ones."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", F.lit(THETA_LOG2)).alias("theta"), F.sum("n_rows").alias("n_rows"))


def estimated(sketches: DataFrame) -> DataFrame:
    """+ by_hll, by_theta: distinct n-grams by either sketch."""
    return sketches.withColumns({"by_hll": F.hll_sketch_estimate("hll"), "by_theta": F.theta_sketch_estimate("theta")})


def overlaps(sketches: DataFrame, group: str) -> DataFrame:
    """a, b, common, of_union: for each two groups (one row a group in `sketches`) what both hold, by intersection of theta sketches, and its share of what either holds.

    One small row a group; the pairs are the report itself.
    """
    x = sketches.select(F.col(group).alias("a"), F.col("theta").alias("ta"))
    y = sketches.select(F.col(group).alias("b"), F.col("theta").alias("tb"))
    pairs = x.join(F.broadcast(y), F.col("a") < F.col("b"))
    common, either = F.theta_sketch_estimate(F.theta_intersection("ta", "tb")), F.theta_sketch_estimate(F.theta_union("ta", "tb", THETA_LOG2))
    return pairs.select("a", "b", common.alias("common"), (common / F.greatest(either, F.lit(1))).alias("of_union"))
