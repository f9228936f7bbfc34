"""Indexes and sketches of a corpus: Bloom filter, suffix automaton, mergeable distinct counts (K-02, T-17, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import bloom, runs, sketches
from lexloom.operators.shared import written
from lexloom.operators.windows import shared_by
from lexloom.plans.contamination import sides_sql
from lexloom.plans.dialect import Plans
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add
docs = lambda s, d: table(s, d, "documents")

add(
    "longest_run_by_item",
    lambda s, d: runs.longest_runs(docs(s, d), table(s, d, "benchmark")),
    """with d as (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from (select doc_id, WORDS(text) w from documents)), b as (select item_id, unnest(w) x, generate_subscripts(w, 1) j from (select item_id, WORDS(text) w from benchmark)),
m as (select doc_id, item_id, i - j diag, i from d join b using (x)), g as (select doc_id, item_id, diag, i - row_number() over (partition by doc_id, item_id, diag order by i) run from m),
r as (select doc_id, item_id, count(*) len from g group by doc_id, item_id, diag, run), t as (select item_id, max(len) longest from r group by 1)
select benchmark.item_id, coalesce(t.longest, 0)::bigint longest, min(r.doc_id) doc_id from benchmark left join t on t.item_id = benchmark.item_id left join r on r.item_id = t.item_id and r.len = t.longest group by 1, 2""",
)

add("bloom_items_13", lambda s, d: bloom.items_met(docs(s, d), table(s, d, "benchmark"), 13), f"with {sides_sql(13)} select item_id, count(distinct g) n_grams from bg where g in (select g from dg) group by 1")


def _false_positives(spark, d, n=5):
    """Hashes that no n-gram has (n-grams salted with a mark) against the filter of all n-grams: how many there are, and whether at most one in a hundred passes."""
    f = bloom.ngram_filter(docs(spark, d), n)
    own = bloom.ngram_hashes(docs(spark, d), n)
    salted = own.select(F.transform("hs", lambda h: F.xxhash64(h, F.lit("absent"))).alias("hs"))
    every = bloom.counted(f, own).select(F.col("n").alias("n_absent"), F.col("n_held").alias("n_kept")).crossJoin(bloom.counted(f, salted).select(F.col("n_held").alias("n_passed")))  # one row each
    return every.select("n_absent", (F.col("n_passed") <= F.col("n_absent") * 0.01).alias("few_pass"), (F.col("n_kept") == F.col("n_absent")).alias("all_kept"))


GRAMS5 = "g as (select doc_id, source, lang, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) g from (select doc_id, source, lang, WORDS(text) w from documents) where len(w) >= 5)"
add("bloom_false_positives", _false_positives, f"with {GRAMS5} select count(distinct g) n_absent, true few_pass, true all_kept from g")


def _kept_sketches(spark, d):
    return written(sketches.ngram_sketches(docs(spark, d), ["source", "lang"]))


def _near(estimate, exact):
    return F.abs(F.col(estimate) - F.col(exact)) <= 0.03 * F.col(exact)


def _distinct(by):
    def query(spark, d):
        """Distinct 5-grams of each group, exactly, and whether both united sketches are within 3 per cent."""
        est = sketches.estimated(sketches.rolled_up(_kept_sketches(spark, d), [by]))
        exact = bloom.ngram_hashes(docs(spark, d), 5, "text", (by,)).select(by, F.explode("hs").alias("h")).distinct().groupBy(by).agg(F.count("*").alias("n"))
        return est.join(exact, est[by].eqNullSafe(exact[by])).select(exact[by], "n", "n_rows", _near("by_hll", "n").alias("hll_near"), _near("by_theta", "n").alias("theta_near"))

    return query


for _by in ("source", "lang"):
    add(f"distinct_ngrams_by_{_by}", _distinct(_by), f"with {GRAMS5} select {_by}, count(distinct g) n, count(*) n_rows, true hll_near, true theta_near from g group by 1")


def _overlap(spark, d):
    """Distinct 5-grams that each two languages share, exactly, and whether the intersection of sketches is within 3 per cent of the union of them."""
    est = sketches.overlaps(sketches.rolled_up(_kept_sketches(spark, d), ["lang"]), "lang")
    met = written(shared_by(docs(spark, d), "lang", 5))
    exact, sizes = met.where("a < b"), met.where("a = b").select(F.col("a").alias("lang"), F.col("n").alias("m"))
    x = est.join(exact, ["a", "b"], "left").na.fill(0, ["n"]).join(sizes.select(F.col("lang").alias("a"), F.col("m").alias("ma")), "a").join(sizes.select(F.col("lang").alias("b"), F.col("m").alias("mb")), "b")
    return x.select("a", "b", "n", (F.abs(F.col("common") - F.col("n")) <= 0.03 * (F.col("ma") + F.col("mb") - F.col("n"))).alias("near"))


add("ngram_overlap_by_lang", _overlap, f"with {GRAMS5}, l as (select distinct lang, g from g), p as (select x.lang a, y.lang b, count(*) n from l x join l y on x.g = y.g and x.lang < y.lang group by 1, 2), k as (select distinct lang from l) select x.lang a, y.lang b, coalesce(n, 0)::bigint n, true near from k x join k y on x.lang < y.lang left join p on p.a = x.lang and p.b = y.lang")
