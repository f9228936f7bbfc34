"""Tokenizer and quality-classifier queries (B and Q rows)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions.text import held, words
from lexloom.operators import bpe
from lexloom.operators.prefix import ranked
from lexloom.plans.dialect import Plans
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add

CHUNKS = r"c as (select chunk, count(*) n from (select unnest(regexp_extract_all(text, '[^\s\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+|\s+')) chunk from documents) group by 1)"
add("bpe_chunk_counts", lambda s, d: bpe.chunk_counts(table(s, d, "documents")), f"with {CHUNKS} select chunk, n from c")
add("bpe_line_pretokens", lambda s, d: table(s, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count("*").alias("n")), "select line, count(*) n from (select unnest(string_split(text, chr(10))) line from documents) group by 1")


def _first_pair(spark, d):
    c = bpe.chunk_counts(table(spark, d, "documents")).select("n", F.hex(F.encode("chunk", "UTF-8")).alias("h")).where("length(h) > 2")
    at = F.explode(F.expr("sequence(0L, length(h) div 2 - 2)")).alias("i")
    pairs = c.select("n", "h", at).select("n", F.expr("substring(h, cast(2 * i + 1 as int), 4)").alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(5)


add("bpe_first_pair", _first_pair, f"with {CHUNKS}, h as (select n, hex(encode(chunk)) h from c), p as (select n, substr(h, 2 * i + 1, 4) pair from (select n, h, unnest(range(0, length(h) // 2 - 1)) i from h)) select pair, sum(n)::bigint n from p group by 1 order by n desc, pair limit 5")


def _trained(spark, d, size=512):
    counts = bpe.chunk_counts(table(spark, d, "documents"))
    merges = bpe.train(counts, size)
    return counts, merges


def _last_merges(spark, d):
    _, merges = _trained(spark, d)
    pieces = {i: bytes([i]) for i in range(256)}
    for k, (a, b) in enumerate(merges):
        pieces[256 + k] = pieces[a] + pieces[b]
    rows = [(k, a, b, pieces[256 + k].decode("utf-8", "replace")) for k, (a, b) in enumerate(merges)][-12:]
    return spark.createDataFrame(rows, "rank long, left_id long, right_id long, piece string")


add("bpe_last_merges", _last_merges)


def _round_trip(spark, d):
    """Distinct chunks, their bytes, and those that decoding gives back."""
    counts, merges = _trained(spark, d, 400)
    return bpe.encoded(counts, merges).agg(F.count("*").alias("n_chunks"), F.sum(F.octet_length("chunk")).alias("n_bytes"), F.count_if("ok").alias("n_back"))


add("bpe_round_trip", _round_trip, f"with {CHUNKS} select count(*) n_chunks, sum(strlen(chunk))::bigint n_bytes, count(*) n_back from c")


def _sweep(spark, d):
    """Tokens by vocabulary size, and what each step saves; the mean gain is the average of `gain`."""
    counts, merges = _trained(spark, d, 512)
    out = None
    for size in (256, 320, 384, 512):
        row = bpe.encoded(counts, merges[: size - 256]).agg(F.lit(size).cast("long").alias("vocab"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"))
        out = row if out is None else out.union(row)
    return out.withColumn("gain", 1 - F.col("tokens") / F.lag("tokens").over(Window.orderBy("vocab")))  # one row a size


add("bpe_vocab_sweep", _sweep)


def _held_out(docs):
    """A fifth of the documents by a hash of the id: what a tokenizer is measured on, and never trained on."""
    return F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0, F.lit(False))


def _fertility(spark, d):
    docs = table(spark, d, "documents")
    return bpe.fertility(docs.where(_held_out(docs)), bpe.train(bpe.chunk_counts(docs.where(~_held_out(docs))), 512), "lang")


def penalty(docs, held_out, size=512, own="en"):
    """by language of the held-out documents: fertility under a tokenizer trained on language `own` alone and under one trained on all, and the ratio."""
    rest, unseen = docs.where(~held_out), docs.where(held_out)
    one = bpe.train(bpe.chunk_counts(rest.where(F.col("lang") == own)), size)
    a = bpe.fertility(unseen, one, "lang").select("lang", F.col("fertility").alias("english_fertility"))
    b = bpe.fertility(unseen, bpe.train(bpe.chunk_counts(rest), size), "lang").select("lang", F.col("fertility").alias("joint_fertility"))
    return a.join(b, a.lang.eqNullSafe(b.lang)).drop(b.lang).withColumn("penalty", F.col("english_fertility") / F.col("joint_fertility"))


def _penalty(spark, d):
    docs = table(spark, d, "documents")
    return penalty(docs, _held_out(docs))


add("bpe_fertility", _fertility)
add("bpe_penalty", _penalty)

#: Two more published pre-token patterns, without look-around: single digits, and runs of Han or kana on their own.
PATTERNS = {"digits": r"[^\s\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+|\s+", "cjk": r"\p{N}{1,3}|[一-龥぀-ゟ゠-ヿ]+|[^\s\p{L}\p{N}]?\p{L}+| ?[^\s\p{L}\p{N}]+|\s+"}
for _k, _p in PATTERNS.items():
    add(f"bpe_chunks_{_k}", lambda s, d, p=_p: bpe.chunk_counts(table(s, d, "documents"), p), CHUNKS.join(["with ", " select chunk, n from c"]).replace(CHUNKS[CHUNKS.index("text, '") + 7 : CHUNKS.index("')) chunk")], _p))
_WORDS_N = "case when COUNT_RE(text, '[⺀-鿿가-힣]') > 0 then greatest(1.0e0, COUNT_RE(text, '[⺀-鿿가-힣]') / 1.5e0) else greatest(1.0e0, DBL(SIZE(WSWORDS(text)))) end"
both("count_words_mixed", f"select doc_id, {_WORDS_N} n from documents")
both("fertility_by_lang", "with t as (select lang, BIG(sum(BYTES(text))) n_bytes, BIG(sum(SIZE(WSWORDS(text)))) n_words, BIG(sum(length(text))) n_chars from documents group by lang), e as (select DBL(n_bytes) / n_words f from t where lang = 'en') select lang, n_bytes, n_words, DBL(n_bytes) / n_words fertility, DBL(n_bytes) / n_words / f penalty, DBL(n_chars) / n_bytes chars_per_token from t cross join e")
both("tokenizer_penalty", "with a as (select lang, DBL(sum(BYTES(text))) / sum(SIZE(WSWORDS(text))) f from documents group by lang), b as (select lang, DBL(sum(SIZE(WORDS(text)))) / sum(SIZE(WSWORDS(text))) f from documents group by lang) select a.lang, a.f byte_fertility, b.f word_fertility, a.f / b.f ratio from a join b on a.lang = b.lang")
both("compression", "select lang, DBL(sum(length(text))) / sum(SIZE(WSWORDS(text))) chars_per_token, DBL(sum(BYTES(text))) / sum(SIZE(WSWORDS(text))) bytes_per_token from documents group by lang")
both("compute_share", "select lang, R6(100 * share * f / sum(share * f) over ()) pct from (values ('en', 40e0, 1.30e0), ('vi', 20e0, 2.45e0), ('ja', 20e0, 1.85e0), ('zh', 20e0, 1.60e0)) v(lang, share, f)")
both("context_in_words", "select lang, ctx, BIG(floor(ctx / f)) words, floor(ctx / f) >= 50000 fits from (values ('en', 1.30e0), ('vi', 2.45e0), ('ja', 1.85e0), ('zh', 1.60e0)) v(lang, f) cross join (values (8192), (32768), (131072)) c(ctx)")
both("embedding_tax", "select vocab, hidden, BIG(vocab) * hidden * 2 params, R6(200e0 * vocab * hidden / total) pct from (values (32000, 4096, 7.0e9), (128256, 4096, 8.0e9), (131072, 8192, 7.0e10)) v(vocab, hidden, total)")


def _zipf_head(spark, d):
    """Shares of the commonest 10, 100 and 1000 words; the counts are ranked without one task that orders them all."""
    c = held(table(spark, d, "documents"), "w", words(F.col("text"))).select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    r = ranked(c.withColumn("tie", F.xxhash64("w")), "n", "tie", "rk", descending=True)
    total = c.agg(F.sum("n").alias("total"))
    k = F.explode(F.filter(F.array(*map(F.lit, (10, 100, 1000))), lambda x: x >= F.col("rk")))
    return r.where("rk <= 1000").select("n", k.alias("k")).groupBy("k").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select("k", (F.col("n") / F.col("total")).alias("share"))


add("zipf_head_mass", _zipf_head, "with r as (select w, n, row_number() over (order by n desc, w) rk, sum(n) over () total from (select w, count(*) n from (select EACH(WORDS(text)) w from documents) x group by w) c) select k, DBL(sum(n)) / max(total) share from r cross join (values (10), (100), (1000)) v(k) where rk <= k group by k")
both("zipf_harmonic", "with h as (select EACH(SEQ(1, 131072)) r) select R6(sum(case when r <= 1000 then 1.0e0 / r else 0 end) / sum(1.0e0 / r)) head from h")

# Q rows. Hashed counts use md5 buckets, which both engines have.
_QF = "select doc_id, text, WORDS(text) w from documents"
both("quality_features", f"with t as ({_QF}) select doc_id, DBL(COUNT_RE(text, '[A-Z]')) / greatest(1, length(text)) upper_ratio, DBL(COUNT_RE(text, '[0-9]')) / greatest(1, length(text)) digit_ratio, least(12.0e0, DBL(length(JOINED(w, ''))) / greatest(1, SIZE(w))) / 12 mean_word, least(1.0e0, 100 * DBL(COUNT_RE(text, '!')) / greatest(1, length(text))) bangs, DBL(SIZE(DISTINCT_OF(w))) / greatest(1, SIZE(w)) distinct_ratio, DBL(COUNT_RE(text, '[#*$%&|<>]')) / greatest(1, length(text)) symbols from t")
both("quality_hashed_counts", f"with t as ({_QF}), b as (select doc_id, H32(e) % 512 bucket from (select doc_id, EACH(w) e from t) x) select doc_id, bucket, count(*) n from b group by doc_id, bucket")
_SCORE = f"with t as ({_QF}), s as (select doc_id, R6(1 / (1 + exp(-(2.0e0 - 40.0e0 * COUNT_RE(text, '[#*$%&|<>]') / greatest(1, length(text)) - 3.0e0 * COUNT_RE(text, '[A-Z]') / greatest(1, length(text)) + 1.0e0 * SIZE(DISTINCT_OF(w)) / greatest(1, SIZE(w)))))) score from t)"
both("quality_score_fixed", _SCORE + " select doc_id, score from s")


def _confusion(spark, d):
    """Actual against predicted over the last quarter of the labelled documents, by a rank that no single task computes."""
    l = QUERIES["quality_score_fixed"](spark, d).join(table(spark, d, "labels"), "doc_id").select("doc_id", "score", "quality")  # noqa: E741
    n = l.agg(F.count("*").alias("n"))
    r = ranked(l, "doc_id", "doc_id", "rn").crossJoin(F.broadcast(n)).where(F.expr("rn > floor(0.75 * n)"))  # one row
    return r.groupBy((F.col("quality") == 1).alias("actual"), (F.col("score") >= 0.9).alias("predicted")).agg(F.count("*").alias("n"))


add("quality_confusion", _confusion, _SCORE + ", l as (select s.doc_id, score, quality, row_number() over (order by s.doc_id) rn, count(*) over () n from s join labels on s.doc_id = labels.doc_id) select quality = 1 actual, score >= 0.9 predicted, count(*) n from l where rn > BIG(floor(0.75 * n)) group by quality = 1, score >= 0.9")
both("quality_heldout_source", _SCORE + " select source = 'src0' held_out, R6(avg(score)) mean_score, COUNT_IF(score >= 0.9) kept, count(*) n from s join documents d on s.doc_id = d.doc_id group by source = 'src0'")
both("quality_percentile_of", _SCORE + " select v, 100 * DBL(COUNT_IF(score <= v)) / count(*) pct from s cross join (values (0.5e0), (0.9e0), (0.95e0)) p(v) group by v")
both("quality_verdicts", _SCORE + " select doc_id, case when score >= 0.9 then 'KEEP' else 'DISCARD' end verdict from s")


def _features(spark, d):
    return QUERIES["quality_features"](spark, d).join(table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")


NAMES = "upper_ratio digit_ratio mean_word bangs distinct_ratio symbols".split()


def _ml(kind: str, held_out):
    """Predictions for the rows that `held_out` names, from a model that never saw them."""

    def query(spark, d):
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor

        rows = _features(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").withColumn("held", held_out())
        f = VectorAssembler(inputCols=NAMES, outputCol="features").transform(rows)
        model = (LogisticRegression(maxIter=30, regParam=0.002) if kind == "lr" else GBTRegressor(maxIter=5, maxDepth=3, seed=1)).fit(f.where("not held"))
        return model.transform(f.where("held")).select("doc_id", "label", F.round(F.col("prediction"), 6).alias("prediction"))

    return query


def fourth():
    return F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0


def _boosted_cut(spark, d):
    """The held-out rows that the boosted trees put into the top seven tenths."""
    p = QUERIES["quality_boosted_trees"](spark, d)
    cut = p.agg(F.percentile("prediction", 0.3).alias("cut"))
    return p.crossJoin(F.broadcast(cut)).where("prediction >= cut").drop("cut")  # one row


add("quality_logistic_regression", _ml("lr", fourth))
add("quality_boosted_trees", _ml("gbt", fourth))
add("quality_boosted_cut", _boosted_cut)
add("quality_unseen_source", _ml("lr", lambda: F.col("source") == "src0"))
