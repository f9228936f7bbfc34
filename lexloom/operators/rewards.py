"""Rewards, advantages and preference losses as columns and group operations.

Sums of doubles depend on the order of rows; `exact` takes them in decimals where
a result must not. Windows are over one group (the samples of a prompt), the only
shuffle is on the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.prefix import ranked


def exact(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(18,6)")


def log_loss(d: Column) -> Column:
    """-log sigmoid(d)."""
    return F.log(1 + F.exp(-d))


def bradley_terry(chosen: Column, rejected: Column, margin: Column | float = 0.0) -> Column:
    return log_loss(chosen - rejected - margin)


def half_credit(chosen: Column, rejected: Column) -> Column:
    """1 for the right order, a half for a tie."""
    return F.when(chosen > rejected, 1.0).when(chosen == rejected, 0.5).otherwise(0.0)


def dpo(policy_chosen: Column, policy_rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> dict[str, Column]:
    """Implicit rewards, margin, loss and correctness of a pair from log probabilities."""
    chosen, rejected = beta * (policy_chosen - ref_chosen), beta * (policy_rejected - ref_rejected)
    return {"chosen": chosen, "rejected": rejected, "margin": chosen - rejected, "loss": log_loss(chosen - rejected), "right": (chosen > rejected).cast("double")}


def sequence_logprob(tokens: DataFrame, group: str, place: str, token: str, logprob: str, prompt: int, pad: int = 0) -> DataFrame:
    """group, total, mean: over the response's tokens (places from `prompt` on) that are not padding; 0 and null without one."""
    counts = (F.col(place) >= prompt) & (F.col(token) != pad)
    return tokens.groupBy(group).agg(F.sum(F.when(counts, F.col(logprob)).otherwise(0.0)).alias("total"), F.avg(F.when(counts, F.col(logprob))).alias("mean"))


def of_group(df: DataFrame, group: str, reward: str) -> DataFrame:
    """+ __n, __sum, __mean, __std of each row's group, from decimal sums."""
    w, r = Window.partitionBy(group), exact(reward)
    out = df.withColumns({"__n": F.count("*").over(w), "__sum": F.sum(r).over(w), "__sq": F.sum(r * r).over(w)})
    total = F.col("__sum").cast("double")
    var = (F.col("__sq").cast("double") - total * total / F.col("__n")) / (F.col("__n") - 1)
    return out.withColumns({"__mean": total / F.col("__n"), "__std": F.when(F.col("__n") > 1, F.sqrt(F.greatest(F.lit(0.0), var)))}).drop("__sq")


def rloo(df: DataFrame, group: str, reward: str, out: str = "adv") -> DataFrame:
    """+ the reward less the mean of the group's others; null in a group of one."""
    others = (F.col("__sum") - exact(reward)).cast("double") / (F.col("__n") - 1)
    return of_group(df, group, reward).withColumn(out, F.when(F.col("__n") > 1, exact(reward).cast("double") - others)).drop("__n", "__sum", "__mean", "__std")


def grpo(df: DataFrame, group: str, reward: str, out: str = "adv", by_std: bool = True, eps: float = 1e-4) -> DataFrame:
    """+ the reward less the group's mean, over its sample deviation; null in a group of one if by_std."""
    adv = F.col(reward) - F.col("__mean")
    return of_group(df, group, reward).withColumn(out, adv / (F.col("__std") + eps) if by_std else adv).drop("__n", "__sum", "__mean", "__std")


def useful_groups(df: DataFrame, group: str, reward: str, least: float = 1e-6) -> DataFrame:
    """group, spread (sample deviation), useful: whether any advantage differs from zero; a group of one is not useful."""
    return of_group(df, group, reward).groupBy(group).agg(F.first("__std").alias("spread")).withColumn("useful", F.coalesce(F.col("spread") >= least, F.lit(False)))


def k3(logp: Column, ref: Column) -> Column:
    """exp(d) - d - 1 with d = ref - logp."""
    d = ref - logp
    return F.exp(d) - d - 1


def clipped_surrogate(ratio: Column, adv: Column, eps: float = 0.2) -> Column:
    return F.least(ratio * adv, F.greatest(F.least(ratio, F.lit(1 + eps)), F.lit(1 - eps)) * adv)


def ppo(df: DataFrame, ratio: Column, adv: Column, mask: Column, eps: float = 0.2) -> DataFrame:
    """surrogate, clip_fraction, tokens: means over the response's tokens (mask true)."""
    some = lambda x: F.avg(F.when(mask, x))
    return df.agg(some(clipped_surrogate(ratio, adv, eps)).alias("surrogate"), some((F.abs(ratio - 1) > eps).cast("double")).alias("clip_fraction"), F.count_if(mask).alias("tokens"))


def gae(df: DataFrame, group: str, place: str, reward: str, value: str, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """group, place, adv for every step of every trajectory, whatever its length: a fold from the last step to the first over one trajectory's array."""
    steps = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(place).alias("t"), F.col(reward).cast("double").alias("r"), F.col(value).cast("double").alias("v"))), asc=False).alias("s"))
    fold = f"""aggregate(s, named_struct('adv', 0D, 'next', 0D, 'out', cast(array() as array<struct<t:bigint,adv:double>>)),
      (a, x) -> named_struct('adv', x.r + {gamma} * a.next - x.v + {gamma * lam} * a.adv, 'next', x.v,
        'out', array_append(a.out, named_struct('t', cast(x.t as bigint), 'adv', x.r + {gamma} * a.next - x.v + {gamma * lam} * a.adv))), a -> a.out)"""
    return steps.select(group, F.inline(F.expr(fold))).withColumnRenamed("t", place)


def adaptive_kl(df: DataFrame, group: str, place: str, kl: Column, target: float, start: float = 0.1, gain: float = 0.1, clip: float = 0.2) -> DataFrame:
    """+ beta: the coefficient after each step of a controller with a clipped proportional error."""
    factor = 1 + gain * F.greatest(F.lit(-clip), F.least(F.lit(clip), kl / target - 1))
    w = Window.partitionBy(group).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("beta", start * F.exp(F.sum(F.log(factor)).over(w)))


def batch_normalised(df: DataFrame, reward: str, out: str = "adv", eps: float = 1e-8) -> DataFrame:
    """+ the reward less the batch's mean, over its sample deviation, and __outlier: more than three deviations above the mean."""
    r = exact(reward)
    s = df.agg(F.count("*").alias("__n"), F.sum(r).cast("double").alias("__s"), F.sum(r * r).cast("double").alias("__q"))
    s = s.select((F.col("__s") / F.col("__n")).alias("__mean"), F.sqrt((F.col("__q") - F.col("__s") * F.col("__s") / F.col("__n")) / (F.col("__n") - 1)).alias("__std"))
    out_ = df.crossJoin(F.broadcast(s))  # one row
    return out_.withColumns({out: (F.col(reward) - F.col("__mean")) / (F.col("__std") + eps), "__outlier": F.col(reward) > F.col("__mean") + 3 * F.col("__std")}).drop("__mean", "__std")


def winsorised(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), value))


def concentration(df: DataFrame, group: str, mass: Column, spread: Column, share: float = 0.1) -> DataFrame:
    """share, corr: of all |advantage|, the part of the top groups (a tenth of them, at least one), and the correlation of a group's spread and mass.

    The groups' masses are ranked by range sums and running sums inside ranges, so no task orders them all.
    """
    per = df.groupBy(group).agg(F.sum(F.abs(mass).cast("decimal(18,9)")).alias("mass"), spread.alias("spread"))
    r = ranked(per, "mass", group, "rn", descending=True)
    n = per.agg(F.count("*").alias("n"))
    top = F.col("rn") <= F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return r.crossJoin(F.broadcast(n)).agg((F.sum(F.when(top, F.col("mass")).otherwise(0)).cast("double") / F.sum("mass").cast("double")).alias("share"), F.round(F.corr("spread", F.col("mass").cast("double")), 6).alias("corr"))


def rollouts_to_reach(steps: DataFrame, step: str, acc: str, rollouts: str, targets: list[float], window: int = 3) -> DataFrame:
    """target, rollouts: spent until the accuracy has held the target for `window` steps in a row; -1 if never. One row a step, so the windows are over the list of steps."""
    w = Window.partitionBy(F.lit(0)).orderBy(step)
    held = steps.withColumns({"lo": F.min(acc).over(w.rowsBetween(1 - window, 0)), "k": F.count("*").over(w.rowsBetween(1 - window, 0)), "spent": F.sum(rollouts).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    out = held.select("*", F.explode(F.array(*map(F.lit, targets))).alias("target"))
    return out.groupBy("target").agg(F.coalesce(F.min(F.when((F.col("k") == window) & (F.col("lo") >= F.col("target")), F.col("spent"))), F.lit(-1)).cast("long").alias("rollouts"))


def token_score(tokens: Column, target: Column, think: int = 0, answer: int = 1, first_digit: int = 2, think_bonus: float = 0.0, length_weight: float = 0.0) -> dict[str, Column]:
    """Parts of the reward of a token array: format (exactly one answer mark, not the last token), accuracy (the digit after it is the target), think (share of think tokens times the bonus), length."""
    marks = F.size(F.filter(tokens, lambda x: x == answer))
    at = F.array_position(tokens, answer)
    well = (marks == 1) & (at < F.size(tokens))
    digit = F.when(well, F.element_at(tokens, F.when(well, at + 1).otherwise(1).cast("int")) - first_digit)
    thought = F.size(F.filter(tokens, lambda x: x == think)) * think_bonus
    return {"format": well.cast("double"), "accuracy": F.coalesce((digit == target).cast("double"), F.lit(0.0)), "think": thought.cast("double"), "length": (F.size(tokens) * length_weight).cast("double")}


def follows(values: Column, shift: int, modulus: int) -> Column:
    """The share of places whose value is the one before plus `shift`, modulo `modulus`; null for fewer than two."""
    pairs = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda b, a: (b == (a + shift) % modulus).cast("int"))
    return F.when(F.size(values) > 1, F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / (F.size(values) - 1))


def ladder(*rungs: tuple[Column, float], otherwise: float) -> Column:
    """The reward of the first rung whose condition holds."""
    out = F.lit(otherwise)
    for condition, reward in reversed(rungs):
        out = F.when(condition, F.lit(reward)).otherwise(out)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b: rows, with repeats, of one side alone; both 0 if the results are equal in any order."""
    only = lambda x, y, name: x.exceptAll(y).agg(F.count("*").alias(name))
    return only(a, b, "only_a").crossJoin(only(b, a, "only_b"))
