"""Statistics of evaluations: intervals, tests, judges, regressions and health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The two-sided 95 per cent point of the normal distribution, as usually rounded.
Z95 = 1.96


def standard_error(p: Column, n: Column) -> Column:
    return F.sqrt(p * (1 - p) / n)


def interval(p: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    return p - z * standard_error(p, n), p + z * standard_error(p, n)


def z_of_difference(p: Column, n: Column, q: Column, m: Column) -> Column:
    """The difference over the standard error of two independent shares."""
    return (p - q) / F.sqrt(p * (1 - p) / n + q * (1 - q) / m)


def required_n(p: Column, difference: Column | float, z: float = Z95) -> Column:
    """Items a side for the difference of two shares near p to reach z."""
    return F.ceil(2 * p * (1 - p) * F.pow(z / F.lit(difference) if isinstance(difference, float) else z / difference, F.lit(2.0))).cast("long")


def accuracy(df: DataFrame, by: list[str], correct: str) -> DataFrame:
    """by, n, p, se, lo, hi."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), (F.sum(correct) / F.count("*")).alias("p"))
    lo, hi = interval(F.col("p"), F.col("n"))
    return g.withColumns({"se": standard_error(F.col("p"), F.col("n")), "lo": lo, "hi": hi})


def mcnemar(df: DataFrame, first: Column, second: Column) -> DataFrame:
    """b, c (items that only one of two systems gets right) and the corrected chi square (null without such items)."""
    g = df.agg(F.count_if(first & ~second).alias("b"), F.count_if(~first & second).alias("c"))
    return g.withColumn("chi2", F.when(F.col("b") + F.col("c") > 0, F.pow(F.abs(F.col("b") - F.col("c")) - 1.0, 2) / (F.col("b") + F.col("c"))))


def position_bias(df: DataFrame, a_first: Column, a_second: Column) -> DataFrame:
    """disagree: pairs that the judge calls otherwise when shown in the other order; corrected: a's win rate over both orders."""
    return df.agg((F.count_if(a_first != a_second) / F.count("*")).alias("disagree"), ((F.count_if(a_first) + F.count_if(a_second)) / F.count("*") / 2).alias("corrected"))


def regressions(checkpoints: DataFrame, order: str, p: str, n: str, z: float = 2.0, points: float = 0.03) -> DataFrame:
    """+ drop_alert: more than z standard errors below the checkpoint before; base_alert: more than `points` below the first. One row a checkpoint."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    prev, base = F.lag(p).over(w), F.first(p).over(w)
    return checkpoints.withColumns({"drop_alert": F.coalesce(prev - F.col(p) > z * standard_error(prev, F.col(n)), F.lit(False)), "base_alert": base - F.col(p) > points})


def shuffled_gap(df: DataFrame, choice: Column, truth: Column, shift: Column, options: int) -> DataFrame:
    """gap: accuracy with options in their order less accuracy with each item's options shifted."""
    shuffled = (choice + shift) % options == truth
    return df.agg(((F.count_if(choice == truth) - F.count_if(shuffled)) / F.count("*")).alias("gap"))


def health_alerts(steps: DataFrame, step: str = "step", loss: str = "loss", grad: str = "grad_norm", seconds: str = "seconds", saved: str = "last_saved", digest: str = "param_hash", rank: str = "rank", grad_limit: float = 10.0, loss_limit: float = 2.0, slow: float = 1.5, stale: int = 1000, recent: int = 100) -> DataFrame:
    """One row a step of the ranks' rows: alerts of non-finite values, loss above `loss_limit` times the last step's, gradient
    norm above its limit or zero, a step slower than `slow` times the median of the `recent` steps before, a checkpoint
    older than `stale` steps, and ranks whose parameters differ. Windows are over one row a step.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    per = steps.groupBy(step).agg(
        F.count_if(~finite(loss) | ~finite(grad)).alias("bad"), F.max(F.when(finite(loss), F.col(loss))).alias("loss"), F.max(F.when(finite(grad), F.col(grad))).alias("grad"),
        F.max(seconds).alias("seconds"), F.max(saved).alias("saved"), F.countDistinct(digest).alias("digests"), F.countDistinct(rank).alias("ranks"),
    )
    w = Window.partitionBy(F.lit(0)).orderBy(step)
    sorted_ = F.array_sort(F.collect_list("seconds").over(w.rowsBetween(-recent, -1)))
    middle = lambda k: F.try_element_at(sorted_, F.floor((F.size(sorted_) + k) / 2).cast("int"))
    usual = F.when(F.size(sorted_) > 0, (middle(1) + middle(2)) / 2)
    return per.select(
        step, (F.col("bad") > 0).alias("non_finite"), F.coalesce(F.col("loss") > loss_limit * F.lag("loss").over(w), F.lit(False)).alias("spike"), F.coalesce(F.col("grad") > grad_limit, F.lit(False)).alias("explosion"),
        F.coalesce(F.col("grad") == 0, F.lit(False)).alias("collapse"), F.coalesce(F.col("seconds") > slow * usual, F.lit(False)).alias("slow"), F.coalesce(F.col(step) - F.col("saved") > stale, F.lit(True)).alias("stale"), (F.col("digests") > 1).alias("diverged"),
    )
