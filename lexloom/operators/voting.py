"""Choosing among samples: votes, best of n, pass rates, and step scorers.

A table of samples has a group (a problem), a place in the group (from 1), and
per sample an answer, a score or a correctness flag (0 or 1). All work is by
group, so a shuffle on the group is the only one; groups are as large as the
number of samples drawn for one problem. Curves over n explode only by the list
of ns asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, group: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the order."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__rn = 1").drop("__rn")


def majority_vote(samples: DataFrame, group: str, answer: str, seen_first: str | None = None) -> DataFrame:
    """group, answer, n: the commonest answer. Ties go to the smallest answer, or with `seen_first` to the one that came first; null answers do not vote."""
    first = [F.min(seen_first).alias("__at")] if seen_first else []
    votes = samples.where(F.col(answer).isNotNull()).groupBy(group, answer).agg(F.count("*").alias("n"), *first)
    return first_by(votes, [group], F.desc("n"), F.col("__at" if seen_first else answer)).select(group, answer, "n")


def prefixes(samples: DataFrame, place: str, ns: list[int], name: str = "n") -> DataFrame:
    """Each sample once for every n of `ns` whose first n samples it is among."""
    return samples.select("*", F.explode(F.filter(F.array(*map(F.lit, ns)), lambda n: n >= F.col(place))).alias(name))


def best_of_n(samples: DataFrame, group: str, place: str, score: str, n: int) -> DataFrame:
    """The sample of the highest score among the first n; the first of equals."""
    return first_by(samples.where(F.col(place) <= n), [group], F.desc(score), F.col(place))


def pass_at_k(samples: DataFrame, group: str, place: str, correct: str, ks: list[int]) -> DataFrame:
    """k, group, any_of (pass@k: any of the first k is right), all_of (pass^k: all are)."""
    return prefixes(samples, place, ks, "k").groupBy("k", group).agg((F.max(correct) == 1).alias("any_of"), (F.min(correct) == 1).alias("all_of"))


def pass_if_independent(p: Column, n: Column | int) -> tuple[Column, Column]:
    """1 - (1 - p)^n and p^n."""
    return 1 - F.pow(1 - p, n), F.pow(p, n)


def best_of_n_curve(samples: DataFrame, group: str, place: str, correct: str, score: str, ns: list[int]) -> DataFrame:
    """n, acc: the share of groups whose best-scored sample of the first n is right; oracle: of those with any right one."""
    of_n = prefixes(samples, place, ns)
    key = F.struct(F.col(score).alias("score"), (-F.col(place)).alias("place"))
    per = of_n.groupBy("n", group).agg(F.max_by(correct, key).alias("right"), F.max(correct).alias("any_right"))
    return per.groupBy("n").agg((F.sum("right") / F.count("*")).alias("acc"), (F.sum("any_right") / F.count("*")).alias("oracle"))


def majority_curve(samples: DataFrame, group: str, place: str, answer: str, truth: str, ns: list[int]) -> DataFrame:
    """n, acc: the share of groups whose majority answer of the first n is the true one."""
    votes = prefixes(samples.where(F.col(answer).isNotNull()), place, ns).groupBy("n", group, answer).agg(F.count("*").alias("votes"), F.max((F.col(answer) == F.col(truth)).cast("int")).alias("right"))
    return first_by(votes, ["n", group], F.desc("votes"), F.col(answer)).groupBy("n").agg((F.sum("right") / F.count("*")).alias("acc"))


def noise_sweep(samples: DataFrame, group: str, place: str, correct: str, noise: str, sigmas: list[float]) -> DataFrame:
    """sigma, acc: the accuracy of the best sample by correctness plus sigma times a stored noise."""
    scored = samples.select("*", F.explode(F.array(*map(F.lit, sigmas))).alias("sigma"))
    best = first_by(scored, ["sigma", group], (F.col(correct) + F.col("sigma") * F.col(noise)).desc(), F.col(place))
    return best.groupBy("sigma").agg((F.sum(correct) / F.count("*")).alias("acc"))


def crossover(sweep: DataFrame, baseline: DataFrame, by: str = "sigma", acc: str = "acc") -> DataFrame:
    """The sweep with the baseline's accuracy (one row) and the first setting that is no better than it; one row a setting."""
    both = sweep.crossJoin(baseline.select(F.col(acc).alias("baseline")))
    at = both.agg(F.min(F.when(F.col(acc) <= F.col("baseline"), F.col(by))).alias("crossover"))
    return both.crossJoin(F.broadcast(at))  # one row


def length_biased(correct: Column, length: Column, weight: Column, longest: float = 60.0) -> Column:
    """A scorer that trades correctness for length."""
    return (1 - weight) * correct + weight * length / longest


def turn_over(curve: DataFrame, by: list[str], n: str = "n", acc: str = "acc") -> DataFrame:
    """by, peak: the first n of the highest accuracy; turns: whether a larger n does worse."""
    key = F.struct(F.col(acc).alias("acc"), (-F.col(n)).alias("n"))
    return curve.groupBy(*by).agg(F.max_by(n, key).alias("peak"), (F.max_by(acc, n) < F.max(acc)).alias("turns"))


def step_aggregates(steps: str, least: float = 1e-6) -> dict[str, Column]:
    """Aggregators of an array of step scores: min, product (scores at least `least`), mean, last."""
    return {
        "min_score": F.array_min(steps), "product": F.aggregate(steps, F.lit(1.0), lambda a, x: a * F.greatest(x, F.lit(least))),
        "mean": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.size(steps), "last_score": F.element_at(steps, -1),
    }


def solutions(steps: DataFrame, group: str, solution: str, step: str, score: str, correct: str) -> DataFrame:
    """One row a solution: scores and correct in the order of steps, final (the last step is right) and all_right. A solution of fewer steps counts with those it has."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(step), F.col(score).alias("score"), F.col(correct).alias("correct"))))
    out = steps.groupBy(group, solution).agg(ordered.alias("s")).select(group, solution, F.col("s.score").alias("scores"), F.col("s.correct").alias("corrects"))
    return out.withColumns({"final": F.element_at("corrects", -1), "all_right": F.forall("corrects", lambda x: x == 1).cast("int")})


def aggregator_accuracy(rows: DataFrame, group: str, solution: str, aggregates: list[str]) -> DataFrame:
    """aggregator, final_right, all_right: of the solution that each aggregator puts first (the first of equals), averaged over groups."""
    long = rows.select(group, solution, "final", "all_right", F.explode(F.array(*[F.struct(F.lit(a).alias("aggregator"), F.col(a).cast("double").alias("v")) for a in aggregates])).alias("x"))
    best = first_by(long.select(group, solution, "final", "all_right", "x.aggregator", "x.v"), ["aggregator", group], F.desc("v"), F.col(solution))
    return best.groupBy("aggregator").agg((F.sum("final") / F.count("*")).alias("final_right"), (F.sum("all_right") / F.count("*")).alias("all_right"))


def largest_drop(values: DataFrame, group: str, step: str, value: str) -> DataFrame:
    """group, step, drop_by: where the value falls most against the step before; the first of equals."""
    w = Window.partitionBy(group).orderBy(step)
    d = values.withColumn("drop_by", F.lag(value).over(w) - F.col(value)).where("drop_by is not null")
    return first_by(d, [group], F.desc("drop_by"), F.col(step)).select(group, step, "drop_by")
