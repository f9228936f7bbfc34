"""Capacity and cost models as columns: each function takes columns or numbers and returns a column, so that a table of configurations is one select."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Value = Column | float
GB = float(1 << 30)


def col(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def attention_parameters(layers: Value, hidden: Value, heads: Value, kv_heads: Value, head_dim: Value) -> Column:
    """Query and output projections, and those of keys and values."""
    return col(layers) * (2 * col(hidden) * col(heads) * col(head_dim) + 2 * col(hidden) * col(kv_heads) * col(head_dim))


def expert_parameters(layers: Value, hidden: Value, ffn: Value) -> Column:
    """Three matrices of a gated feed-forward block, of one expert."""
    return col(layers) * 3 * col(hidden) * col(ffn)


def kv_bytes(layers: Value, kv_heads: Value, head_dim: Value, width: float = 2) -> Column:
    """Bytes of the cache for each token: a key and a value."""
    return 2.0 * col(layers) * col(kv_heads) * col(head_dim) * width


def static_memory_gb(params: Value, bytes_per_param: Value) -> Column:
    return col(params) * col(bytes_per_param) / GB


def link_seconds(size: Value, gbps: Value, latency_us: Value, over: Value = 1.0) -> Column:
    """One message over a link whose bandwidth is shared `over` times."""
    return col(size) / (col(gbps) / col(over) * 1e9) + col(latency_us) / 1e6


def ring_allreduce(size: Value, ranks: Value, gbps: Value, latency_us: Value, over: Value = 1.0) -> Column:
    """Seconds of 2 (n - 1) steps that move 2 (n - 1) / n of the buffer."""
    return 2 * (col(ranks) - 1) / col(ranks) * col(size) / (col(gbps) / col(over) * 1e9) + 2 * (col(ranks) - 1) * col(latency_us) / 1e6


def all_to_all(size: Value, ranks: Value, gbps: Value, latency_us: Value, over: Value = 1.0) -> Column:
    return (col(ranks) - 1) / col(ranks) * col(size) / (col(gbps) / col(over) * 1e9) + (col(ranks) - 1) * col(latency_us) / 1e6


def pipeline_bubble(stages: Value, microbatches: Value) -> Column:
    return (col(stages) - 1) / (col(microbatches) + col(stages) - 1)


def checkpoint_interval(cost_s: Value, mtbf_h: Value) -> Column:
    """The interval in seconds that loses least: sqrt(2 C MTBF)."""
    return F.sqrt(2 * col(cost_s) * col(mtbf_h) * 3600)


def checkpoint_overhead(cost_s: Value, mtbf_h: Value) -> Column:
    """The share of time for saving and for work that is lost, at that interval."""
    t = checkpoint_interval(cost_s, mtbf_h)
    return col(cost_s) / t + t / (2 * col(mtbf_h) * 3600)


def cluster_mtbf_h(gpus: Value, gpu_mtbf_h: float = 50_000.0) -> Column:
    return gpu_mtbf_h / col(gpus)


def rope_frequency(i: Value, dim: float, base: float = 10_000.0, scale: float = 1.0, kind: str = "none", context: float = 4096.0, slow: float = 1.0, fast: float = 32.0) -> Column:
    """The inverse frequency of pair i: unscaled, by interpolated positions (pi), by a larger base (ntk), or by a ramp between both over the turns in the context (yarn)."""
    plain = F.pow(F.lit(base), -2 * col(i) / dim)
    if kind == "none":
        return plain
    if kind == "pi":
        return plain / scale
    if kind == "ntk":
        return F.pow(F.lit(base * scale ** (dim / (dim - 2))), -2 * col(i) / dim)
    if kind == "yarn":
        keep = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (context * plain / (2 * math.pi) - slow) / (fast - slow)))
        return plain * (keep + (1 - keep) / scale)
    raise ValueError("kind is none, pi, ntk or yarn")


def fit_scaling(runs: DataFrame, n: str, loss: str, highest: float = 2.7, grid: int = 3000) -> DataFrame:
    """i, e, slope, intercept, sse of loss = e + exp(intercept + slope ln n): a line in logarithms for each e of a grid, the first of least squared error.

    Runs are few: every grid point is fitted by its own group.
    """
    e = runs.sparkSession.range(grid).select(F.col("id").alias("i"), (F.col("id") * highest / grid).alias("e"))
    x = runs.select(F.log(n).alias("lx"), F.col(loss).cast("double").alias("loss")).crossJoin(e).withColumn("ly", F.when(F.col("loss") > F.col("e"), F.log(F.col("loss") - F.col("e"))))
    f = x.groupBy("i", "e").agg(F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.collect_list(F.struct("lx", "loss")).alias("p"), (F.count("ly") == F.count("*")).alias("whole"))
    error = F.aggregate("p", F.lit(0.0), lambda s, v: s + F.pow(F.col("e") + F.exp(F.col("intercept") + F.col("slope") * v["lx"]) - v["loss"], 2))
    scored = f.where("whole").withColumn("sse", error)  # an e above some loss has no fit
    best = F.row_number().over(Window.orderBy(F.round("sse", 12), "i"))  # one row a grid point
    return scored.withColumn("rn", best).where("rn = 1").select("i", "e", "slope", "intercept", "sse")


def predicted(fit: DataFrame, n: Value) -> DataFrame:
    return fit.withColumn("predicted", F.col("e") + F.exp(F.col("intercept") + F.col("slope") * F.log(col(n))))
