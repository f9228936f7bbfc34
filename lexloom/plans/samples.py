"""Voting, verifiers, preferences, advantages and evaluation statistics (V, P and N rows).

Inputs come from `events`: a prompt is a user, a sample a place in time order,
the reward is `value`, correct means a purchase, length is props.k, the answer
k % 8 (true if it is the prompt's number modulo 8); preference pairs are
consecutive samples. The queries call the operators of `lexloom.operators`; the
oracles are SQL of their own. Sums of rewards are taken in decimals, so that they
do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions.text import md5_bucket, words
from lexloom.operators import evaluation as E
from lexloom.operators import rewards as R
from lexloom.operators import voting as V
from lexloom.operators.prefix import ranked, tiled
from lexloom.plans.dialect import Plans
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add

S = "with s as (select user_id prompt_id, BIG(row_number() over (partition by user_id order by ts, event_id)) sample_id, value reward, cast(value as decimal(18, 6)) rd, case when event_type = 'purchase' then 1 else 0 end correct, JSONK(props) len, JSONK(props) % 8 answer from events)"
PAIRS = S + ", p as (select prompt_id, sample_id, reward rc, lead(reward) over (partition by prompt_id order by sample_id) rr, len lc, lead(len) over (partition by prompt_id order by sample_id) lr from s), q as (select * from p where rr is not null)"
GROUPS = S + ", g as (select *, count(*) over (partition by prompt_id) n, sum(rd) over (partition by prompt_id) total, sum(rd * rd) over (partition by prompt_id) sq from s), a as (select *, DBL(total) / n mean, sqrt(greatest(0.0e0, (DBL(sq) - DBL(total) * DBL(total) / n) / (n - 1))) std from g where n > 1)"


def samples(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, d, "events").select(
        F.col("user_id").alias("prompt_id"), place.alias("sample_id"), F.col("value").alias("reward"), (F.col("event_type") == "purchase").cast("int").alias("correct"), k.alias("len"), (k % 8).alias("answer"),
        (F.col("user_id") % 8).alias("truth"),
    )


def pairs(spark, d):
    w = Window.partitionBy("prompt_id").orderBy("sample_id")
    s = samples(spark, d).select("prompt_id", "sample_id", F.col("reward").alias("rc"), F.lead("reward").over(w).alias("rr"), F.col("len").alias("lc"), F.lead("len").over(w).alias("lr"))
    return s.where("rr is not null")


def r6(x):
    return F.round(x.cast("double"), 6)


def named(*parts):
    return F.concat(*[F.lit(x) if x in (":", "-", "/") else F.col(x).cast("string") for x in parts])


def gauss(*parts):
    """A normal variate from two hashes of a name (Box and Muller), to six places."""
    u, v = ((md5_bucket(F.concat(named(*parts), F.lit(x))) + 1) / 4294967297.0 for x in ("a", "b"))
    return F.round(F.sqrt(-2 * F.log(u)) * F.cos(2 * 3.141592653589793 * v), 6)


_NAME = "concat(cast(prompt_id as varchar(20)), ':', cast(sample_id as varchar(20)))"
_GAUSS = f"R6(sqrt(-2 * LN((H32(concat({_NAME}, 'a')) + 1) / 4294967297.0e0)) * cos(2 * 3.141592653589793e0 * ((H32(concat({_NAME}, 'b')) + 1) / 4294967297.0e0)))"
NS, SIGMAS, WEIGHTS, ALL = [1, 4, 16, 64], [0.0, 0.5, 1.0, 2.0, 4.0], [0.0, 0.3, 0.6, 0.9], 1 << 30

add("majority_vote", lambda s, d: V.majority_vote(samples(s, d), "prompt_id", "answer"), S + ", c as (select prompt_id, answer, count(*) n from s group by prompt_id, answer), r as (select prompt_id, answer, n, row_number() over (partition by prompt_id order by n desc, answer) rn from c) select prompt_id, answer, n from r where rn = 1")
add("majority_vote_parsed", lambda s, d: V.majority_vote(samples(s, d).withColumn("answer", F.when(F.col("len") >= 10, F.col("answer"))), "prompt_id", "answer", "sample_id").select("prompt_id", "answer"), S + ", c as (select prompt_id, answer, count(*) n, min(sample_id) first_at from s where len >= 10 group by prompt_id, answer), r as (select prompt_id, answer, row_number() over (partition by prompt_id order by n desc, first_at) rn from c) select prompt_id, answer from r where rn = 1")
add("best_of_n", lambda s, d: V.best_of_n(samples(s, d), "prompt_id", "sample_id", "reward", 16).select("prompt_id", "sample_id", "reward", "correct"), S + ", r as (select prompt_id, sample_id, reward, correct, row_number() over (partition by prompt_id order by reward desc, sample_id) rn from s where sample_id <= 16) select prompt_id, sample_id, reward, correct from r where rn = 1")
add("outcome_scorer", lambda s, d: samples(s, d).select("prompt_id", "sample_id", r6(F.col("correct") + gauss("prompt_id", ":", "sample_id")).alias("score")), S + f" select prompt_id, sample_id, R6(correct + {_GAUSS}) score from s")
add("pass_at_k", lambda s, d: V.pass_at_k(samples(s, d), "prompt_id", "sample_id", "correct", [1, 4, 16]).select("k", "prompt_id", F.col("any_of").alias("passed")), S + " select k, prompt_id, max(correct) = 1 passed from s cross join (values (1), (4), (16)) v(k) where sample_id <= k group by k, prompt_id")
add("pass_hat_k", lambda s, d: V.pass_at_k(samples(s, d), "prompt_id", "sample_id", "correct", [1, 2, 4]).select("k", "prompt_id", F.col("all_of").alias("passed")), S + " select k, prompt_id, min(correct) = 1 passed from s cross join (values (1), (2), (4)) v(k) where sample_id <= k group by k, prompt_id")


def _independent(spark, d):
    p = samples(spark, d).groupBy("prompt_id").agg((F.sum("correct") / F.count("*")).alias("p")).select("p", F.explode(F.array(*map(F.lit, [1, 4, 16]))).alias("n"))
    some, every = V.pass_if_independent(F.col("p"), F.col("n"))
    return p.groupBy("n").agg(r6(F.avg(some)).alias("pass_at"), r6(F.avg(every)).alias("pass_hat"))


add("pass_at_n_independent", _independent, S + ", p as (select prompt_id, DBL(sum(correct)) / count(*) p from s group by prompt_id) select n, R6(avg(1 - pow(1 - p, n))) pass_at, R6(avg(pow(p, n))) pass_hat from p cross join (values (1), (4), (16)) v(n) group by n")
add("bon_curve", lambda s, d: V.best_of_n_curve(samples(s, d), "prompt_id", "sample_id", "correct", "reward", [1, 2, 4, 8, 16]), S + ", r as (select n, prompt_id, correct, row_number() over (partition by n, prompt_id order by reward desc, sample_id) rn from s cross join (values (1), (2), (4), (8), (16)) v(n) where sample_id <= n), o as (select n, prompt_id, max(correct) any_right from s cross join (values (1), (2), (4), (8), (16)) v(n) where sample_id <= n group by n, prompt_id) select r.n, DBL(sum(correct)) / count(*) acc, DBL(sum(any_right)) / count(*) oracle from r join o on r.n = o.n and r.prompt_id = o.prompt_id where rn = 1 group by r.n")


def _crossover(spark, d):
    s = samples(spark, d).withColumns({"right": (F.col("answer") == F.col("truth")).cast("int"), "noise": gauss("prompt_id", ":", "sample_id")})
    return V.crossover(V.noise_sweep(s, "prompt_id", "sample_id", "right", "noise", SIGMAS), V.majority_curve(s, "prompt_id", "sample_id", "answer", "truth", [ALL]))


add(
    "noise_crossover", _crossover,
    S + f", z as (select prompt_id, sample_id, case when answer = prompt_id % 8 then 1 else 0 end ok, {_GAUSS} noise from s), r as (select sigma, ok, row_number() over (partition by sigma, prompt_id order by ok + sigma * noise desc, sample_id) rn from z cross join (values (0.0e0), (0.5e0), (1.0e0), (2.0e0), (4.0e0)) v(sigma)), "
    "acc as (select sigma, DBL(sum(ok)) / count(*) acc from r where rn = 1 group by sigma), c as (select prompt_id, answer, count(*) n from s group by prompt_id, answer), m as (select prompt_id, answer, row_number() over (partition by prompt_id order by n desc, answer) rn from c), "
    "b as (select DBL(COUNT_IF(answer = prompt_id % 8)) / count(*) baseline from m where rn = 1) select sigma, acc, baseline, min(case when acc <= baseline then sigma end) over () crossover from acc cross join b",
)


def _length_biased(spark, d):
    s = samples(spark, d).select("*", F.explode(F.array(*map(F.lit, WEIGHTS))).alias("w"))
    s = s.withColumn("score", V.length_biased(F.col("correct"), F.col("len"), F.col("w"))).withColumn("of", F.struct("w", "prompt_id"))
    key = F.struct("score", (-F.col("sample_id")).alias("place"))
    curve = V.prefixes(s, "sample_id", NS).groupBy("w", "n", "prompt_id").agg(F.max_by("correct", key).alias("ok")).groupBy("w", "n").agg((F.sum("ok") / F.count("*")).alias("acc"))
    return V.turn_over(curve, ["w"])


add("length_biased_scorer", _length_biased, S + ", r as (select w, n, correct, row_number() over (partition by w, n, prompt_id order by (1 - w) * correct + w * len / 60e0 desc, sample_id) rn from s cross join (values (0.0e0), (0.3e0), (0.6e0), (0.9e0)) v(w) cross join (values (1), (4), (16), (64)) u(n) where sample_id <= n), a as (select w, n, DBL(sum(correct)) / count(*) acc from r where rn = 1 group by w, n), p as (select *, row_number() over (partition by w order by acc desc, n) rn, max(acc) over (partition by w) top, row_number() over (partition by w order by n desc) back from a) select w, max(case when rn = 1 then n end) peak, max(case when back = 1 then acc end) < max(top) turns from p group by w")


def _solutions(spark, d):
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.000001), F.col("len") / 100.0))
    steps = samples(spark, d).select("prompt_id", F.expr("(sample_id - 1) div 5").alias("sol"), ((F.col("sample_id") - 1) % 5).alias("step"), score.alias("score"), "correct")
    rows = V.solutions(steps, "prompt_id", "sol", "step", "score", "correct")
    return rows.withColumns({k: F.round(v, 9) for k, v in V.step_aggregates("scores").items()})


AGGREGATES = ["min_score", "product", "mean", "last_score"]
_STEPS = S + ", st as (select prompt_id, IDIV(sample_id - 1, 5) sol, sample_id, least(1.0e0, greatest(0.000001e0, len / 100e0)) score, correct from s), ag as (select prompt_id, sol, round(min(score), 9) min_score, round(list_product(list(score order by sample_id)), 9) product, round(list_sum(list(score order by sample_id)) / count(*), 9) mean, round(arg_max(score, sample_id), 9) last_score, arg_max(correct, sample_id) final, min(correct) all_right from st group by prompt_id, sol)"
add("prm_aggregators", lambda s, d: _solutions(s, d).select("prompt_id", "sol", *[r6(F.col(c)).alias(c) for c in AGGREGATES]), _STEPS + " select prompt_id, sol, R6(min_score) min_score, R6(product) product, R6(mean) mean, R6(last_score) last_score from ag")
add("prm_accuracy", lambda s, d: V.aggregator_accuracy(_solutions(s, d), "prompt_id", "sol", AGGREGATES), _STEPS + ", u as (" + " union all ".join(f"select '{c}' aggregator, prompt_id, sol, {c} v, final, all_right from ag" for c in ("min_score", "product", "mean", "last_score")) + "), r as (select *, row_number() over (partition by aggregator, prompt_id order by v desc, sol) rn from u) select aggregator, DBL(sum(final)) / count(*) final_right, DBL(sum(all_right)) / count(*) all_right from r where rn = 1 group by aggregator")
add("solution_statistics", lambda s, d: _solutions(s, d).agg(F.count("*").alias("n"), (F.sum("final") / F.count("*")).alias("correct"), (F.count_if(F.expr("final = 1 and all_right = 0")) / F.count("*")).alias("lucky"), (F.sum("all_right") / F.count("*")).alias("all_right")), _STEPS + " select count(*) n, DBL(sum(final)) / count(*) correct, DBL(COUNT_IF(final = 1 and all_right = 0)) / count(*) lucky, DBL(sum(all_right)) / count(*) all_right from ag")
add("step_values", lambda s, d: V.largest_drop(samples(s, d).groupBy("prompt_id", F.expr("(sample_id - 1) div 8").alias("step")).agg((F.sum("correct") / F.count("*")).alias("val")), "prompt_id", "step", "val"), S + ", v as (select prompt_id, IDIV(sample_id - 1, 8) step, DBL(sum(correct)) / count(*) val from s group by prompt_id, IDIV(sample_id - 1, 8)), d as (select prompt_id, step, val, lag(val) over (partition by prompt_id order by step) - val drop_by from v), r as (select prompt_id, step, drop_by, row_number() over (partition by prompt_id order by drop_by desc, step) rn from d where drop_by is not null) select prompt_id, step, drop_by from r where rn = 1")
both("accuracy_vs_compute", S + ", o as (select n, prompt_id, max(correct) ok, sum(len) tokens from s cross join (values (1), (4), (16)) v(n) where sample_id <= n group by n, prompt_id) select n, DBL(sum(ok)) / count(*) acc, DBL(sum(tokens)) / count(*) tokens_per_query, R6(DBL(sum(tokens)) / count(*) * 2 / 1000000) cost from o group by n")

_OUT = {"acc": lambda: F.avg(R.half_credit(F.col("rc"), F.col("rr"))), "gap": lambda: F.sum(R.exact("rc") - R.exact("rr")).cast("double") / F.count("*")}
add("bt_loss", lambda s, d: pairs(s, d).agg(r6(F.avg(R.bradley_terry(F.col("rc") / 100, F.col("rr") / 100))).alias("loss"), r6(F.avg(R.bradley_terry(F.col("rc") / 100, F.col("rr") / 100, 0.5))).alias("margin_loss")), PAIRS + " select R6(avg(LN(1 + exp(-(rc - rr) / 100)))) loss, R6(avg(LN(1 + exp(-((rc - rr) / 100 - 0.5e0))))) margin_loss from q")
add("pair_accuracy", lambda s, d: pairs(s, d).agg(_OUT["acc"]().alias("acc"), r6(_OUT["gap"]()).alias("gap")), PAIRS + " select sum(case when rc > rr then 1.0e0 when rc = rr then 0.5e0 else 0.0e0 end) / count(*) acc, R6(DBL(sum(cast(rc as decimal(18, 6)) - cast(rr as decimal(18, 6)))) / count(*)) gap from q")
both("length_bias", S + " select R6(coalesce(corr(reward, len), 0)) r, R6(pow(coalesce(corr(reward, len), 0), 2)) r2 from s")
both("length_effect", S + ", m as (select DBL(sum(case when len > 50 then rd end)) / count(case when len > 50 then 1 end) long_mean, DBL(sum(case when len <= 50 then rd end)) / count(case when len <= 50 then 1 end) short_mean from s) select R6(long_mean - short_mean) effect from m")
both("correctness_effect", S + ", c as (select len, correct, DBL(sum(rd)) / count(*) m from s group by len, correct) select R6(avg(a.m - b.m)) effect, count(*) n from c a join c b on a.len = b.len and a.correct = 1 and b.correct = 0")
both("length_probe", S + " select len, count(*) n, R6(DBL(sum(rd)) / count(*)) mean_reward from s group by len")


def _stratified(spark, d):
    g = pairs(spark, d).groupBy(F.expr("lc div 25").alias("stratum")).agg(F.count("*").alias("n"), F.avg(R.half_credit(F.col("rc"), F.col("rr"))).alias("acc"))
    total = g.agg((F.sum(F.col("n") * F.col("acc")) / F.sum("n")).alias("weighted"))
    return g.crossJoin(F.broadcast(total)).select("stratum", "n", "acc", r6(F.col("weighted")).alias("weighted"))  # one row


add("stratified_accuracy", _stratified, PAIRS + ", g as (select IDIV(lc, 25) stratum, count(*) n, sum(case when rc > rr then 1.0e0 when rc = rr then 0.5e0 else 0.0e0 end) / count(*) acc from q group by IDIV(lc, 25)), w as (select sum(case when rc > rr then 1.0e0 when rc = rr then 0.5e0 else 0.0e0 end) / count(*) weighted from q) select stratum, n, acc, R6(weighted) weighted from g cross join w")
both("stratified_golden", "select R6(sum(w * a)) acc from (values (0.2e0, 0.91e0), (0.3e0, 0.82e0), (0.35e0, 0.68e0), (0.15e0, 0.53e0)) v(w, a)")


def _length_matched(spark, d):
    """Deciles of the chosen length, by a rank that no single task computes; pairs of one prompt and place order ties."""
    p = pairs(spark, d).withColumn("tie", F.col("prompt_id") * 1_000_000 + F.col("sample_id"))
    n = p.agg(F.count("*").alias("total"))
    b = ranked(p, "lc", "tie", "place").crossJoin(F.broadcast(n)).withColumn("bin", tiled(F.col("place"), F.col("total"), 10))  # one row
    return b.where("abs(lc - lr) <= 10").groupBy("bin").agg(F.count("*").alias("n"), (F.count_if(F.expr("rc > rr")) / F.count("*")).alias("win"))


add("length_matched_winrate", _length_matched, PAIRS + ", b as (select BIG(ntile(10) over (order by lc, prompt_id * 1000000 + sample_id)) bin, lc, lr, rc, rr from q) select bin, count(*) n, DBL(sum(case when rc > rr then 1 else 0 end)) / count(*) win from b where abs(lc - lr) <= 10 group by bin")
_DPO = PAIRS + ", x as (select rc / 100 pc, rr / 100 pr, lc / 50e0 fc, lr / 50e0 fr from q), y as (select 0.1e0 * (pc - fc) wc, 0.1e0 * (pr - fr) wr from x)"


def _dpo(spark, d):
    return pairs(spark, d).select((F.col("rc") / 100).alias("pc"), (F.col("rr") / 100).alias("pr"), (F.col("lc") / 50.0).alias("fc"), (F.col("lr") / 50.0).alias("fr"))


def _dpo_metrics(spark, d):
    x = R.dpo(*map(F.col, ("pc", "pr", "fc", "fr")))
    return _dpo(spark, d).agg(r6(F.avg(x["loss"])).alias("loss"), r6(F.avg(x["chosen"])).alias("chosen"), r6(F.avg(x["rejected"])).alias("rejected"), r6(F.avg(x["right"])).alias("acc"), r6(F.avg(x["margin"])).alias("margin"))


def _dpo_identity(spark, d):
    """The loss with the policy as its own reference, and pairs on which a second formulation of the loss (the stable softplus) agrees."""
    same, x = R.dpo(*map(F.col, ("pc", "pr", "pc", "pr"))), R.dpo(*map(F.col, ("pc", "pr", "fc", "fr")))
    softplus = F.greatest(-x["margin"], F.lit(0.0)) + F.log1p(F.exp(-F.abs(x["margin"])))
    return _dpo(spark, d).agg(r6(F.avg(same["loss"])).alias("loss_at_reference"), r6(F.max(F.abs(same["chosen"]) + F.abs(same["rejected"]))).alias("rewards_at_reference"), F.count_if(F.abs(x["loss"] - softplus) < 1e-9).alias("agree"), F.count("*").alias("n"))


add("dpo_metrics", _dpo_metrics, _DPO + " select R6(avg(LN(1 + exp(-(wc - wr))))) loss, R6(avg(wc)) chosen, R6(avg(wr)) rejected, R6(avg(case when wc > wr then 1.0e0 else 0.0e0 end)) acc, R6(avg(wc - wr)) margin from y")
add("dpo_identity", _dpo_identity, PAIRS + " select R6(0.6931471805599453e0) loss_at_reference, R6(0.0e0) rewards_at_reference, count(*) agree, count(*) n from q")


def _sequence_logprob(spark, d):
    tokens = samples(spark, d).withColumn("logprob", -F.log(1.0 + F.col("len")))
    return R.sequence_logprob(tokens, "prompt_id", "sample_id", "len", "logprob", 3).select("prompt_id", r6(F.col("total")).alias("total"), r6(F.col("mean")).alias("mean"))


add("sequence_logprob", _sequence_logprob, S + " select prompt_id, R6(sum(case when sample_id >= 3 and len <> 0 then -LN(1.0e0 + len) else 0 end)) total, R6(avg(case when sample_id >= 3 and len <> 0 then -LN(1.0e0 + len) end)) mean from s group by prompt_id")


def _drift(spark, d):
    """Mean absolute change of the policy, and the implicit reward of long answers less that of short ones."""
    p = pairs(spark, d)
    mean = lambda side: F.avg(F.when(side, 0.1 * (F.col("rc") - F.col("rr"))))
    return p.agg(r6(F.sum(F.abs(R.exact("rc") - R.exact("rr"))).cast("double") / F.count("*")).alias("drift"), r6(mean(F.col("lc") > F.col("lr")) - mean(F.col("lc") <= F.col("lr"))).alias("long_preference"))


add("policy_drift", _drift, PAIRS + " select R6(DBL(sum(abs(cast(rc as decimal(18, 6)) - cast(rr as decimal(18, 6))))) / count(*)) drift, R6((sum(case when lc > lr then 0.1e0 * (rc - rr) end) / sum(case when lc > lr then 1 end)) - (sum(case when lc <= lr then 0.1e0 * (rc - rr) end) / sum(case when lc <= lr then 1 end))) long_preference from q")
add("rloo_adv", lambda s, d: R.rloo(samples(s, d), "prompt_id", "reward").where("adv is not null").select("prompt_id", "sample_id", F.round("adv", 9).alias("adv")), GROUPS + " select prompt_id, sample_id, R9(DBL(rd) - DBL(total - rd) / (n - 1)) adv from a")
add("grpo_adv", lambda s, d: R.grpo(R.grpo(samples(s, d), "prompt_id", "reward"), "prompt_id", "reward", "adv_no_std", False).where("adv is not null").select("prompt_id", "sample_id", F.round("adv", 9).alias("adv"), F.round("adv_no_std", 9).alias("adv_no_std")), GROUPS + " select prompt_id, sample_id, R9((reward - mean) / (std + 0.0001e0)) adv, R9(reward - mean) adv_no_std from a")
_SPREAD = S + ", z as (select prompt_id, {step} step, count(*) n, stddev_samp(correct) spread from s group by prompt_id, {step}) "
add("zero_adv_groups", lambda s, d: R.useful_groups(samples(s, d), "prompt_id", "correct").select("prompt_id", r6(F.col("spread")).alias("spread"), "useful"), _SPREAD.format(step="0").replace(", 0 step", ", 0 step").replace("group by prompt_id, 0", "group by prompt_id") + "select prompt_id, R6(spread) spread, coalesce(spread >= 0.000001, false) useful from z")


def _zero_rate(spark, d):
    """By step of eight samples a prompt: the share of groups, whole or not, whose advantages are all zero."""
    s = samples(spark, d).withColumn("step", F.expr("(sample_id - 1) div 8")).withColumn("of", F.struct("prompt_id", "step"))
    return R.useful_groups(s, "of", "correct").groupBy(F.col("of.step").alias("step")).agg((F.count_if(~F.col("useful")) / F.count("*")).alias("zero_rate"), F.count("*").alias("groups"))


add("zero_adv_rate", _zero_rate, _SPREAD.format(step="IDIV(sample_id - 1, 8)") + "select step, DBL(COUNT_IF(not coalesce(spread >= 0.000001, false))) / count(*) zero_rate, count(*) groups from z group by step")
add("k3_kl", lambda s, d: pairs(s, d).agg(r6(F.avg(R.k3(F.col("rc") / 500, F.col("rr") / 500))).alias("k3")), PAIRS + " select R6(avg(exp((rr - rc) / 500) - (rr - rc) / 500 - 1)) k3 from q")


def _ppo(spark, d):
    """The first two places of a prompt are its prompt and masked."""
    out = R.ppo(pairs(spark, d), F.exp((F.col("rc") - F.col("rr")) / 500), (F.col("rc") - 50) / 100, F.col("sample_id") > 2)
    return out.select(r6(F.col("surrogate")).alias("surrogate"), "clip_fraction", "tokens")


add("ppo_clip", _ppo, PAIRS + ", x as (select exp((rc - rr) / 500) ratio, (rc - 50) / 100 adv from q where sample_id > 2) select R6(avg(least(ratio * adv, greatest(0.8e0, least(ratio, 1.2e0)) * adv))) surrogate, DBL(COUNT_IF(ratio > 1.2e0 or ratio < 0.8e0)) / count(*) clip_fraction, count(*) tokens from x")
add("gae", lambda s, d: R.gae(samples(s, d), "prompt_id", "sample_id", "reward", "reward").select("prompt_id", "sample_id", F.round(F.col("adv") + 0.000000001, 6).alias("adv")), S + ", d as (select prompt_id, sample_id, reward + 0.99e0 * coalesce(lead(reward) over (partition by prompt_id order by sample_id), 0) - reward delta from s) select a.prompt_id, a.sample_id, round(sum(pow(0.99e0 * 0.95e0, b.sample_id - a.sample_id) * b.delta) + 0.000000001e0, 6) adv from d a join d b on a.prompt_id = b.prompt_id and b.sample_id >= a.sample_id group by a.prompt_id, a.sample_id")
add("adaptive_kl", lambda s, d: R.adaptive_kl(samples(s, d), "prompt_id", "sample_id", F.col("reward"), 60.0).select("prompt_id", "sample_id", r6(F.col("beta")).alias("beta")), S + ", e as (select prompt_id, sample_id, 1 + 0.1e0 * greatest(-0.2e0, least(0.2e0, reward / 60 - 1)) f from s) select prompt_id, sample_id, R6(0.1e0 * exp(sum(LN(f)) over (partition by prompt_id order by sample_id rows unbounded preceding))) beta from e")
add("batch_normalised_adv", lambda s, d: R.batch_normalised(samples(s, d), "reward").groupBy(F.col("__outlier").alias("outlier")).agg(F.count("*").alias("n"), r6(F.sum(F.abs(r6(F.col("adv"))).cast("decimal(18,6)"))).alias("mass")), S + ", m as (select DBL(sum(rd)) / count(*) mean, sqrt((DBL(sum(rd * rd)) - DBL(sum(rd)) * DBL(sum(rd)) / count(*)) / (count(*) - 1)) std from s), z as (select prompt_id, sample_id, R6((reward - mean) / (std + 0.00000001e0)) adv, reward > mean + 3 * std outlier from s cross join m) select outlier, count(*) n, R6(sum(cast(abs(adv) as decimal(18, 6)))) mass from z group by outlier")
add("reward_winsorised", lambda s, d: samples(s, d).groupBy("prompt_id").agg(r6(F.sum(R.exact(R.winsorised(F.col("reward"), 1.0, 200.0))).cast("double") / F.count("*")).alias("mean")), S + " select prompt_id, R6(DBL(sum(cast(least(200.0e0, greatest(1.0e0, reward)) as decimal(18, 6)))) / count(*)) mean from s group by prompt_id")
add("rule_fraction", lambda s, d: samples(s, d).groupBy("prompt_id").agg(F.array_sort(F.collect_list(F.struct("sample_id", "answer"))).alias("x")).select("prompt_id", R.follows(F.col("x.answer"), 3, 8).alias("share")).where("share is not null"), S + ", l as (select prompt_id, sample_id, answer, (lag(answer) over (partition by prompt_id order by sample_id) + 3) % 8 want from s) select prompt_id, DBL(sum(case when answer = want then 1 else 0 end)) / count(*) share from l where want is not null group by prompt_id")


def _format_rewards(spark, d):
    """Assistant turns as arrays of twelve tokens (0 think, 1 answer, digits from 2), hashed from their words; the target is the turn plus three."""
    t = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.transform(words(F.col("text")), lambda w: md5_bucket(w) % 12).alias("x"))
    parts = R.token_score(F.col("x"), (F.col("turn") + 3) % 10, think_bonus=0.05, length_weight=-0.001)
    return t.select("conv_id", "turn", *[r6(v).alias(k + "_reward") for k, v in parts.items()], r6(sum(parts.values(), F.lit(0.0))).alias("reward"))


add(
    "format_rewards", _format_rewards,
    "with t as (select conv_id, turn, list_transform(WORDS(text), lambda w: H32(w) % 12) x from conversations where role = 'assistant'), p as (select conv_id, turn, x, len(list_filter(x, lambda v: v = 1)) = 1 and list_position(x, 1) < len(x) ok from t), "
    "q as (select conv_id, turn, case when ok then 1.0e0 else 0.0e0 end f, case when ok and x[list_position(x, 1) + 1] - 2 = (turn + 3) % 10 then 1.0e0 else 0.0e0 end a, len(list_filter(x, lambda v: v = 0)) * 0.05e0 th, len(x) * -0.001e0 le from p) "
    "select conv_id, turn, R6(f) format_reward, R6(a) accuracy_reward, R6(th) think_reward, R6(le) length_reward, R6(f + a + th + le) reward from q",
)
add("rollouts_to_reach", lambda s, d: R.rollouts_to_reach(samples(s, d).groupBy(F.col("sample_id").alias("step")).agg((F.sum("correct") / F.count("*")).alias("acc"), F.count("*").alias("n")), "step", "acc", "n", [0.1, 0.2, 0.9]), S + ", a as (select sample_id step, DBL(sum(correct)) / count(*) acc, count(*) n from s group by sample_id), w as (select step, min(acc) over (order by step rows between 2 preceding and current row) lo, count(*) over (order by step rows between 2 preceding and current row) k, sum(n) over (order by step rows unbounded preceding) rollouts from a) select target, coalesce(min(case when k = 3 and lo >= target then BIG(rollouts) end), -1) rollouts from w cross join (values (0.1e0), (0.2e0), (0.9e0)) v(target) group by target")
add("adv_concentration", lambda s, d: R.concentration(R.grpo(samples(s, d), "prompt_id", "reward", by_std=False), "prompt_id", F.round("adv", 9), (F.max("reward") - F.min("reward"))), S + ", g as (select *, count(*) over (partition by prompt_id) n, DBL(sum(rd) over (partition by prompt_id)) / count(*) over (partition by prompt_id) mean from s), g2 as (select prompt_id, sum(cast(abs(R9(reward - mean)) as decimal(18, 9))) mass, max(reward) - min(reward) spread from g group by prompt_id), r as (select prompt_id, mass, spread, row_number() over (order by mass desc, prompt_id) rn, count(*) over () n from g2) select DBL(sum(case when rn <= greatest(1, IDIV(n, 10)) then mass else 0 end)) / DBL(sum(mass)) share, R6(corr(spread, DBL(mass))) corr from r")


def _rule_reward(spark, d):
    """1 for a well-formed text whose first word is the right answer (the language's article), 0.1 for the form alone."""
    first = F.lower(F.regexp_extract("text", r"^\s*(\p{L}+)", 1))
    form = F.coalesce(F.col("text").rlike(r"[.!?]\s*$"), F.lit(False))
    want = F.when(F.col("lang") == "fr", "le").when(F.col("lang") == "de", "der").when(F.col("lang") == "es", "el").otherwise("the")
    return table(spark, d, "documents").select("doc_id", R.ladder((~form, 0.0), (first == want, 1.0), otherwise=0.1).alias("reward"))


add("rule_reward", _rule_reward, r"select doc_id, case when not coalesce(regexp_matches(text, '[.!?]\s*$'), false) then 0.0e0 when lower(regexp_extract(text, '^\s*(\p{L}+)', 1)) = case lang when 'fr' then 'le' when 'de' then 'der' when 'es' then 'el' else 'the' end then 1.0e0 else 0.1e0 end reward from documents")


def _turns(spark, d):
    """Assistant turns with the user turn before them and what the ladders ask of a text."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumns({"asked": F.lag("text").over(w), "n_turns": F.count("*").over(Window.partitionBy("conv_id"))}).where("role = 'assistant'")
    return t.withColumns({"w": words(F.col("text")), "q": words(F.coalesce("asked", F.lit("")))})


def _sql_ladder(spark, d):
    """Rungs: no form (a role marker in the text), not parsed (no full stop at the end), unknown names (no word shared with the question), wrong result (other words), right."""
    form, parsed = ~F.col("text").rlike("<(user|assistant|end)>"), F.col("text").rlike(r"[.]\s*$")
    known, equal = F.arrays_overlap("w", "q"), F.array_sort("w") == F.array_sort("q")
    return _turns(spark, d).select("conv_id", "turn", R.ladder((~form, 0.0), (~parsed, 0.1), (~known, 0.3), (~equal, 0.5), otherwise=1.0).alias("reward"))


def _agentic_ladder(spark, d):
    """A forged marker disqualifies; a solved task (the last word of the question is in the answer) earns 1 and, in few turns, 0.1 more; else a long conversation earns nothing."""
    forged, solved = F.col("text").rlike("<(user|assistant|end)>"), F.coalesce(F.array_contains("w", F.try_element_at("q", F.lit(-1))), F.lit(False))
    return _turns(spark, d).select("conv_id", "turn", R.ladder((forged, -1.0), (solved & (F.col("n_turns") <= 4), 1.1), (solved, 1.0), (F.col("n_turns") > 6, 0.0), otherwise=0.2).alias("reward"))


_TURNS = "with t as (select conv_id, turn, role, text, WORDS(text) w, WORDS(coalesce(lag(text) over (partition by conv_id order by turn), '')) q, count(*) over (partition by conv_id) n_turns from conversations) select conv_id, turn, case when {first} MATCHES(text, '<(user|assistant|end)>') then {rest} end reward from t where role = 'assistant'"
add("sql_reward_ladder", _sql_ladder, _TURNS.format(first="", rest="0.0e0 when not regexp_matches(text, '[.]\\s*$') then 0.1e0 when not list_has_any(w, q) then 0.3e0 when list_sort(w) <> list_sort(q) then 0.5e0 else 1.0e0"))
add("agentic_reward_ladder", _agentic_ladder, _TURNS.format(first="", rest="-1.0e0 when len(q) > 0 and list_contains(w, q[-1]) then case when n_turns <= 4 then 1.1e0 else 1.0e0 end when n_turns > 6 then 0.0e0 else 0.2e0"))
add("set_equality", lambda s, d: R.same_rows(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")), table(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k")).distinct()), "with a as (select n_nationkey k from nation), b as (select distinct s_nationkey k from supplier) select (select count(*) from (select k from a except all select k from b) x) only_a, (select count(*) from (select k from b except all select k from a) y) only_b")
both("agreement_ceiling", "select a, R6(a + (1 - a) / 2) ceiling from (values (0.6e0), (0.7e0), (0.8e0)) v(a)")
both("answer_entropy", S + ", c as (select prompt_id, answer, count(*) n from s group by prompt_id, answer), p as (select prompt_id, DBL(n) / sum(n) over (partition by prompt_id) p from c) select prompt_id, R6(-sum(p * LN(p))) h from p group by prompt_id")

add("accuracy_ci", lambda s, d: E.accuracy(samples(s, d), ["answer"], "correct").select("answer", "n", *[r6(F.col(c)).alias(c) for c in ("p", "se", "lo", "hi")]), S + ", g as (select answer, count(*) n, DBL(sum(correct)) / count(*) p from s group by answer) select answer, n, R6(p) p, R6(sqrt(p * (1 - p) / n)) se, R6(p - 1.96e0 * sqrt(p * (1 - p) / n)) lo, R6(p + 1.96e0 * sqrt(p * (1 - p) / n)) hi from g")


def _ci_golden(spark, d):
    """The worked example: 67.1 per cent of 164 items, against 64.6, and the items that a difference of 2.5 points needs."""
    g = spark.range(1).select(F.lit(0.671).alias("p"), F.lit(164).alias("n"), F.lit(0.646).alias("q"))
    lo, hi = E.interval(F.col("p"), F.col("n"))
    return g.select(r6(E.standard_error(F.col("p"), F.col("n"))).alias("se"), r6(lo).alias("lo"), r6(hi).alias("hi"), r6(E.z_of_difference(F.col("p"), F.col("n"), F.col("q"), F.col("n"))).alias("z"), E.required_n((F.col("p") + F.col("q")) / 2, 0.025).alias("needed"))


add("accuracy_ci_golden", _ci_golden, "select R6(0.036689e0) se, R6(0.599089e0) lo, R6(0.742911e0) hi, R6(0.477556e0) z, BIG(2765) needed")
add("mcnemar", lambda s, d: E.mcnemar(pairs(s, d), F.col("rc") > 50, F.col("rr") > 50).withColumn("chi2", r6(F.col("chi2"))), PAIRS + " select BIG(sum(case when rc > 50 and rr <= 50 then 1 else 0 end)) b, BIG(sum(case when rc <= 50 and rr > 50 then 1 else 0 end)) c, R6(pow(abs(sum(case when rc > 50 and rr <= 50 then 1 else 0 end) - sum(case when rc <= 50 and rr > 50 then 1 else 0 end)) - 1.0e0, 2) / sum(case when (rc > 50) <> (rr > 50) then 1 else 0 end)) chi2 from q")
add("judge_position_bias", lambda s, d: E.position_bias(pairs(s, d), F.col("rc") + 5 > F.col("rr"), F.col("rc") > F.col("rr") + 5).select("disagree", r6(F.col("corrected")).alias("corrected")), PAIRS + ", o as (select rc + 5 > rr first_a, rc > rr + 5 second_a from q) select DBL(COUNT_IF(first_a <> second_a)) / count(*) disagree, R6((DBL(COUNT_IF(first_a)) / count(*) + DBL(COUNT_IF(second_a)) / count(*)) / 2) corrected from o")
both("length_matched_judge", PAIRS + " select abs(lc - lr) <= 10 matched, count(*) n, DBL(COUNT_IF(rc > rr)) / count(*) win, DBL(sum(lc)) / count(*) mean_len from q group by abs(lc - lr) <= 10")
add("regression_alerts", lambda s, d: E.regressions(samples(s, d).groupBy(F.expr("(sample_id - 1) div 10").alias("ckpt")).agg((F.sum("correct") / F.count("*")).alias("p"), F.count("*").alias("n")), "ckpt", "p", "n").drop("n"), S + ", c as (select IDIV(sample_id - 1, 10) ckpt, DBL(sum(correct)) / count(*) p, count(*) n from s group by IDIV(sample_id - 1, 10)), l as (select ckpt, p, n, lag(p) over (order by ckpt) prev, first_value(p) over (order by ckpt) base from c) select ckpt, p, coalesce(prev - p > 2 * sqrt(prev * (1 - prev) / n), false) drop_alert, base - p > 0.03e0 base_alert from l")
both("format_spread", S + ", f as (select len % 4 fmt, DBL(sum(correct)) / count(*) acc from s group by len % 4) select max(acc) - min(acc) spread, max(acc) - avg(acc) best_bias from f".replace("max(acc) - avg(acc) best_bias", "R6(max(acc) - avg(acc)) best_bias"))
both("category_cube", "select event_type, user_id % 3 tier, count(*) n, R6(DBL(sum(cast(value as decimal(18, 6)))) / count(*)) mean from events group by cube (event_type, user_id % 3)".replace("user_id % 3 tier", "tier").replace("from events group by cube (event_type, user_id % 3)", "from (select event_type, user_id % 3 tier, value from events) e group by cube (event_type, tier)"))


def training_log(spark, d, *more):
    """A training log from `events`: four ranks a step, with a loss, a gradient norm, a time, the last checkpoint and a hash of the parameters."""
    k, e = F.get_json_object("props", "$.k").cast("long"), F.col("event_id")
    return table(spark, d, "events").select(
        *more, F.expr("event_id div 4").alias("step"), (e % 4).alias("rank"), F.when(e % 997 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"), (k / 8.0).alias("grad_norm"),
        (F.when(e % 211 == 0, 9.0).otherwise(1.0) + k / 1000.0).alias("seconds"), F.expr("(event_id div 4) div 1500 * 1500").alias("last_saved"), (F.when(e % 503 == 3, 1).otherwise(0) + F.expr("event_id div 4") * 7).alias("param_hash"),
    )


add(
    "health_checks", lambda s, d: E.health_alerts(training_log(s, d)),
    "with l as (select IDIV(event_id, 4) step, event_id % 4 rank, case when event_id % 997 = 0 then 'nan'::double else value end loss, JSONK(props) / 8.0e0 grad, case when event_id % 211 = 0 then 9.0e0 else 1.0e0 end + JSONK(props) / 1000.0e0 secs, IDIV(IDIV(event_id, 4), 1500) * 1500 saved, case when event_id % 503 = 3 then 1 else 0 end + IDIV(event_id, 4) * 7 h from events), "
    "p as (select step, count(*) filter (where isnan(loss) or grad is null) bad, max(loss) filter (where not isnan(loss)) loss, max(grad) grad, max(secs) secs, max(saved) saved, count(distinct h) hs from l group by step), "
    "w as (select *, lag(loss) over (order by step) prev, median(secs) over (order by step rows between 100 preceding and 1 preceding) usual from p) "
    "select step, bad > 0 non_finite, coalesce(loss > 2 * prev, false) spike, coalesce(grad > 10, false) explosion, coalesce(grad = 0, false) collapse, coalesce(secs > 1.5 * usual, false) slow, coalesce(step - saved > 1000, true) stale, hs > 1 diverged from w",
)
both("perplexity_gap", S + " select R6(exp(avg(case when correct = 1 then len / 50e0 end)) - exp(avg(case when correct = 0 then len / 50e0 end))) gap from s")
add("option_order_gap", lambda s, d: E.shuffled_gap(samples(s, d), F.col("answer"), F.col("truth"), md5_bucket(named("prompt_id", "/", "sample_id")) % 8, 8), S + " select (DBL(COUNT_IF(answer = prompt_id % 8)) - COUNT_IF((answer + H32(concat(cast(prompt_id as varchar(20)), '/', cast(sample_id as varchar(20)))) % 8) % 8 = prompt_id % 8)) / count(*) gap from s")


def _decontaminated_score(spark, d):
    """Accuracy over the items that no document shares eight words in a row with; an item's mark is a hash, as the tables have no model answers."""
    from lexloom.plans.contamination import items

    clean = items(8)(spark, d).where("n_docs = 0").join(table(spark, d, "benchmark"), "item_id").select((md5_bucket(F.col("text")) % 10 < 6).cast("int").alias("ok"))
    g = E.accuracy(clean, [], "ok")
    return g.select("n", r6(F.col("p")).alias("p"), r6(F.col("hi") - F.col("p")).alias("half"))


def _decontaminated_sql():
    from lexloom.plans.contamination import grams_sql

    return f"with {grams_sql('dg', 'documents', 'doc_id', 8)}, {grams_sql('bg', 'benchmark', 'item_id', 8)}, h as (select distinct item_id from bg where g in (select g from dg)), s as (select case when H32(text) % 10 < 6 then 1 else 0 end ok from benchmark where item_id not in (select item_id from h)), g as (select count(*) n, DBL(sum(ok)) / count(*) p from s) select n, R6(p) p, R6(1.96e0 * sqrt(p * (1 - p) / n)) half from g"


add("decontaminated_score", _decontaminated_score, _decontaminated_sql())
