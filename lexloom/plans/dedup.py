"""Deduplication queries (D rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import dedup as D
from lexloom.plans.dialect import Plans
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add
docs = lambda s, d: table(s, d, "documents")

both("exact_dedup", "select min(doc_id) doc_id, count(*) copies from documents group by sha256(text)", "select min(doc_id) doc_id, count(*) copies from documents group by sha2(text, 256)")
both("exact_dedup_recall", "with g as (select count(*) n from documents group by sha256(text)) select BIG(sum(n - 1)) removed, BIG(sum(n)) total, DBL(sum(n - 1)) / sum(n) share from g", "with g as (select count(*) n from documents group by sha2(text, 256)) select BIG(sum(n - 1)) removed, BIG(sum(n)) total, DBL(sum(n - 1)) / sum(n) share from g")

SHINGLES = """w as materialized (select doc_id, WORDS(text) w from documents),
sh as materialized (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w)"""
PAIRS = SHINGLES + """, c as materialized (select doc_id, count(*) n from sh group by 1),
i as materialized (select x.doc_id a, y.doc_id b, count(*) inter from sh x join sh y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
pairs as materialized (select a, b, inter, p.n + q.n - inter uni from i join c p on p.doc_id = a join c q on q.doc_id = b where inter >= 0.7 * (p.n + q.n - inter))"""
COMPONENTS = PAIRS + """, e as (select a, b from pairs union all select b, a from pairs), r(doc_id, m) as (select doc_id, doc_id from documents union select e.b, r.m from r join e on r.doc_id = e.a and r.m < e.b),
comp as materialized (select doc_id, min(m) component from r group by 1)"""

add("shingle_counts", lambda s, d: D.shingle_table(docs(s, d)).groupBy("doc_id").agg(F.count("*").alias("n")), f"with {SHINGLES} select doc_id, count(*) n from sh group by 1")
add("near_dup_pairs_exact", lambda s, d: D.similar_pairs(docs(s, d), 0.7), f"with {PAIRS} select * from pairs")
add("jaccard_verified", lambda s, d: D.similar_pairs(docs(s, d), 0.7).select("a", "b", (F.col("inter").cast("double") / F.col("uni")).alias("jaccard")), f"with {PAIRS} select a, b, DBL(inter) / uni jaccard from pairs")

PERMS = D.permutations(16)


def _perm_sql(perms) -> str:
    return "(values " + ", ".join(f"({i}, {a}::hugeint, {b}::hugeint)" for i, (a, b) in enumerate(perms)) + ") p(i, a, b)"


def _sig_sql(perms) -> str:
    return f"{SHINGLES}, x as (select doc_id, H32(g) x from sh), sig as materialized (select doc_id, i, BIG(min(((a * x + b) % 2305843009213693951) & 4294967295)) h from x cross join {_perm_sql(perms)} group by 1, 2)"


add(
    "minhash_signatures",
    lambda s, d: D.signatures(docs(s, d), PERMS).select("doc_id", F.posexplode("sig").alias("i", "h")).select("doc_id", F.col("i").cast("long").alias("i"), "h"),
    f"with {_sig_sql(PERMS)} select doc_id, p.i::bigint i, coalesce(h, 4294967295) h from documents cross join {_perm_sql(PERMS)} left join sig using (doc_id, i)",
)


def _error_by_k(spark, d):
    sig = D.written(D.signatures(docs(spark, d), PERMS))
    pairs = D.similar_pairs(docs(spark, d), 0.7)
    j = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    out = None
    for k in (4, 8, 16):
        same = F.size(F.filter(F.zip_with(F.slice("sa", 1, k), F.slice("sb", 1, k), lambda x, y: x == y), lambda e: e))
        row = j.select(F.abs(same / F.lit(float(k)) - F.col("inter") / F.col("uni")).alias("err")).agg(F.lit(k).cast("long").alias("k"), F.count("*").alias("n"), F.round(F.avg("err"), 6).alias("mean_abs_err"))
        out = row if out is None else out.union(row)
    return out


add(
    "minhash_error_by_k", _error_by_k,
    f"with {_sig_sql(PERMS)}, c as (select doc_id, count(*) n from sh group by 1), i as (select x.doc_id a, y.doc_id b, count(*) inter from sh x join sh y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2), "
    "pairs as (select a, b, inter, p.n + q.n - inter uni from i join c p on p.doc_id = a join c q on q.doc_id = b where inter >= 0.7 * (p.n + q.n - inter)), "
    "k as (select unnest([4, 8, 16])::bigint k), s as (select k, a, b, inter, uni, count(*) filter (where u.h = v.h) same from pairs join sig u on u.doc_id = a join sig v on v.doc_id = b and u.i = v.i join k on u.i < k group by all) "
    "select k, count(*) n, round(avg(abs(same / k::double - inter / uni::double)), 6) mean_abs_err from s group by 1",
)
BANDS = "band as (select doc_id, i // {r} band, string_agg(h::varchar, ',' order by i) key from full_sig group by 1, 2), cand as materialized (select distinct x.doc_id a, y.doc_id b from band x join band y on x.band = y.band and x.key = y.key and x.doc_id < y.doc_id)"
FULL = f"full_sig as materialized (select doc_id, p.i i, coalesce(h, 4294967295) h from documents cross join {_perm_sql(PERMS)} left join sig using (doc_id, i))"
add("lsh_candidates", lambda s, d: D.lsh_candidates(D.written(D.signatures(docs(s, d), PERMS)), 4, 4), f"with {_sig_sql(PERMS)}, {FULL}, {BANDS.format(r=4)} select a, b from cand")


def _precision_recall(spark, d):
    out = D.lsh_counts(docs(spark, d), PERMS, ((2, 8), (4, 4), (8, 2)), 0.7)
    ratio = lambda x: F.when(F.col(x) > 0, F.col("hits").cast("double") / F.col(x)).otherwise(0.0)
    return out.select("bands", (F.lit(16) / F.col("bands")).cast("long").alias("n_rows"), "candidates", "truth", "hits", ratio("candidates").alias("precision"), ratio("truth").alias("recall"))


add(
    "lsh_precision_recall", _precision_recall,
    f"with {_sig_sql(PERMS)}, {FULL}, c as (select doc_id, count(*) n from sh group by 1), ii as (select x.doc_id a, y.doc_id b, count(*) inter from sh x join sh y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2), "
    "truth as materialized (select a, b from ii join c p on p.doc_id = a join c q on q.doc_id = b where inter >= 0.7 * (p.n + q.n - inter)), "
    "cfg as (select unnest([2, 4, 8])::bigint bands), band as (select bands, doc_id, i // (16 // bands) band, string_agg(h::varchar, ',' order by i) key from full_sig cross join cfg group by 1, 2, 3), "
    "cand as materialized (select distinct x.bands, x.doc_id a, y.doc_id b from band x join band y on x.bands = y.bands and x.band = y.band and x.key = y.key and x.doc_id < y.doc_id), "
    "m as (select cfg.bands, (select count(*) from cand where cand.bands = cfg.bands) candidates, (select count(*) from truth) truth, (select count(*) from cand join truth using (a, b) where cand.bands = cfg.bands) hits from cfg) "
    "select bands, 16 // bands n_rows, candidates, truth, hits, case when candidates > 0 then hits::double / candidates else 0 end \"precision\", case when truth > 0 then hits::double / truth else 0 end recall from m",
)
both("lsh_s_curve", "select b, r, s, R6(1 - pow(1 - pow(s, r), b)) p, R6(pow(1.0 / b, 1.0 / r)) knee from (values (16, 8), (32, 4), (21, 6)) c(b, r) cross join (values (0.5e0), (0.7e0), (0.8e0), (0.9e0)) v(s)")
both("signature_economics", "select k, BIG(10000000000) * k * 4 bytes, 10000000000e0 * 10000000000e0 / 2 all_pairs from (values (32), (128), (256)) v(k)")


def _labels(spark, d):
    return D.written(D.components(docs(spark, d), D.links(docs(spark, d), 0.7)))


add("dedup_components", _labels, f"with recursive {COMPONENTS} select doc_id, component from comp")
add("dedup_keep_first", lambda s, d: D.keep_first(_labels(s, d)), f"with recursive {COMPONENTS} select component, min(doc_id) doc_id from comp group by 1")


def _scored(spark, d):
    lab = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("long").alias("q"))
    return _labels(spark, d).join(lab, "doc_id", "left").withColumn("score", F.coalesce("q", F.lit(0)))


LABELLED = COMPONENTS + ", q as (select doc_id, max(quality)::bigint q from labels group by 1), scored as (select comp.doc_id, component, coalesce(q, 0) score from comp left join q using (doc_id))"
add("dedup_keep_best", lambda s, d: D.keep_best(_scored(s, d), "score"), f"with recursive {LABELLED} select component, arg_max(doc_id, [score, -doc_id]) doc_id from scored group by 1")


def _order_of_operations(spark, d):
    """Dedup then filter, filter then dedup, and the quality-aware election: survivors and what only one of them keeps."""
    s = D.written(_scored(spark, d))
    a = D.keep_first(s).join(s.where("score > 0"), "doc_id", "left_semi").select("doc_id")
    good = s.where("score > 0").select("doc_id")
    edges = D.links(docs(spark, d).join(good, "doc_id", "left_semi"), 0.7)
    b = D.keep_first(D.components(good, edges)).select("doc_id")
    c = D.keep_best(s, "score").join(s.where("score > 0"), "doc_id", "left_semi").select("doc_id")
    tag = lambda df, name: df.select(F.lit(name).alias("pipeline"), F.col("doc_id"))
    m = tag(a, "dedup_first").union(tag(b, "filter_first")).union(tag(c, "best_first"))
    only = F.sum(F.when(F.col("n") == 1, 1).otherwise(0))
    counts = m.groupBy("doc_id").agg(F.count("*").alias("n"))
    return m.join(counts, "doc_id").groupBy("pipeline").agg(F.count("*").alias("survivors"), only.alias("only_here"))


add(
    "order_of_operations", _order_of_operations,
    f"with recursive {LABELLED}, good as (select doc_id from scored where score > 0), ge as (select a, b from pairs where a in (from good) and b in (from good)), g2 as (select a, b from ge union all select b, a from ge), "
    "r2(doc_id, m) as (select doc_id, doc_id from good union select g2.b, r2.m from r2 join g2 on r2.doc_id = g2.a and r2.m < g2.b), c2 as (select doc_id, min(m) component from r2 group by 1), "
    "m as (select 'dedup_first' pipeline, doc_id from (select min(doc_id) doc_id from comp group by component) where doc_id in (from good) union all select 'filter_first', min(doc_id) from c2 group by component "
    "union all select 'best_first', doc_id from (select arg_max(doc_id, [score, -doc_id]) doc_id from scored group by component) where doc_id in (from good)), n as (select doc_id, count(*) n from m group by 1) "
    "select pipeline, count(*) survivors, (count(*) filter (where n = 1))::bigint only_here from m join n using (doc_id) group by 1",
)
both("mirror_report", "select source, count(*) n, count(distinct sha256(text)) distinct_texts from documents group by source", "select source, count(*) n, count(distinct sha2(text, 256)) distinct_texts from documents group by source")
_URL = "REPLACE_ALL(REPLACE_ALL(REPLACE_ALL(lower(url), '^[a-z]+://(www[.]|m[.])?', ''), '[?#].*$', ''), '/+$', '')"
both("url_dedup", f"select {_URL} canonical, min(page_id) survivor, count(*) n from pages group by 1".replace("group by 1", f"group by {_URL}"))
_LINE = {"spark": "(select doc_id, BIG(pos) pos, col line from (select doc_id, posexplode(LINES(text)) from documents))", "duck": "(select doc_id, BIG(unnest(range(0, len(LINES(text))))) pos, unnest(LINES(text)) line from documents)"}
_LINES = "with l as {t}, c as (select line, count(distinct doc_id) n from l where length(line) > 20 group by line having count(distinct doc_id) > 2) "
both("line_dedup_shared", (_LINES + "select line, n from c").format(t=_LINE["duck"]), (_LINES + "select line, n from c").format(t=_LINE["spark"]))
_REBUILD = "select doc_id, md5({agg}) kept_md5, count(*) n_lines from l left join c on l.line = c.line where c.line is null group by doc_id"
both("line_dedup", (_LINES + _REBUILD.format(agg="string_agg(l.line, chr(10) order by pos)")).format(t=_LINE["duck"]), (_LINES + _REBUILD.format(agg="listagg(l.line, '\\n') within group (order by pos)")).format(t=_LINE["spark"]))
_SENT = {"spark": r"(select doc_id, BIG(pos) pos, trim(col) s from (select doc_id, posexplode(split(text, '[.]')) from documents))", "duck": "(select doc_id, BIG(unnest(range(0, len(string_split(text, '.'))))) pos, trim(unnest(string_split(text, '.'))) s from documents)"}
# the first occurrence of a sentence or paragraph stays; texts are put together again


def _units(mark, joiner):
    def query(spark, d):
        return D.keep_first_units(docs(spark, d), mark).select("doc_id", F.md5("text").alias("text_md5"), "n_removed")

    sql = f"with u as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), {joiner}), 1) pos, unnest(string_split(coalesce(text, ''), {joiner})) unit from documents), r as (select *, length(trim(unit)) > 20 and row_number() over (partition by trim(unit) order by doc_id, pos) > 1 gone from u) select doc_id, md5(coalesce(string_agg(unit, {joiner} order by pos) filter (where not gone), '')) text_md5, count(*) filter (where gone) n_removed from r group by doc_id"
    return query, sql


add("sentence_dedup", *_units("[.]", "'.'"))
add("paragraph_dedup", *_units("\n", "chr(10)"))
_WIN = "(select doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) h from (select doc_id, w, unnest(range(1, len(w) - 18)) i from (select doc_id, WORDS(text) w from documents)))"
_RW = "with x as {t}, c as (select h, count(*) n, min(doc_id) first_doc from x group by h having count(*) > 1) select h, n, first_doc from c"
add("repeated_windows", lambda s, d: D.repeated_windows(docs(s, d)), _RW.format(t=_WIN))
add("repeated_window_docs", lambda s, d: D.mask_repeated_windows(docs(s, d)).select("doc_id", F.md5(F.array_join("words", " ")).alias("kept_md5"), "n_removed"), "with w as materialized (select doc_id, WORDS(coalesce(text, '')) w from documents), x as (select doc_id, i, array_to_string(w[i:i + 19], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 18)) i from w)), r as (select doc_id, i, row_number() over (partition by g order by doc_id, i) rn from x), b as (select distinct doc_id, unnest(range(i, i + 20)) p from r where rn > 1), k as (select doc_id, unnest(w) e, generate_subscripts(w, 1) p from w), m as (select k.doc_id, string_agg(e, ' ' order by k.p) filter (where b.p is null) t, count(b.p) n from k left join b on b.doc_id = k.doc_id and b.p = k.p group by 1) select w.doc_id, md5(coalesce(t, '')) kept_md5, coalesce(n, 0)::bigint n_removed from w left join m on m.doc_id = w.doc_id")
_SIM = "with w as (select doc_id, EACH(WORDS(text)) w from documents), h as (select doc_id, H32(w) h from w) select doc_id, " + " + ".join(f"case when sum(case when {{t{b}}} then 1 else -1 end) > 0 then {1 << b} else 0 end" for b in range(16)) + " simhash from h group by doc_id"
both("simhash16", ("select doc_id, BIG(simhash) simhash from (" + _SIM + ") s").format(**{f"t{b}": f"(h >> {b}) & 1 = 1" for b in range(16)}), ("select doc_id, BIG(simhash) simhash from (" + _SIM + ") s").format(**{f"t{b}": f"getbit(h, {b}) = 1" for b in range(16)}))
add(
    "simhash_pairs", lambda s, d: D.hamming_pairs(QUERIES["simhash16"](s, d), "doc_id", "simhash", 16, 1),
    ("with sh as (select doc_id, BIG(simhash) simhash from (" + _SIM + ") s)").format(**{f"t{b}": f"(h >> {b}) & 1 = 1" for b in range(16)}) + " select x.doc_id a, y.doc_id b, bit_count(xor(x.simhash, y.simhash))::bigint distance from sh x join sh y on x.doc_id < y.doc_id and bit_count(xor(x.simhash, y.simhash)) <= 1",
)
# permutations in the numbers that are used at scale
WIDE = D.permutations(128)
CONFIGS = ((32, 4), (16, 8), (8, 16))


def _error_wide(spark, d):
    """Mean error of the estimate by k next to its theory, sqrt(j (1 - j) / k), over the exact pairs."""
    every = docs(spark, d).where("doc_id is not null")
    found = D.weighed_pairs(every, 0.7)
    ids = D.written(found.pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sig = D.written(D.signatures(D.of_ids(every, ids, every.select("doc_id")), WIDE))  # of sets in a pair of two; copies have no error
    side = lambda k: sig.select(F.col("doc_id").alias(k), F.col("sig").alias("s" + k))
    same = F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")).alias("same")
    across = found.pairs.join(side("a"), "a").join(side("b"), "b").select((F.col("inter") / F.col("uni")).alias("j"), same, "w")
    copies = spark.range(1).select(F.lit(1.0).alias("j"), F.array_repeat(F.lit(1), 128).alias("same"), F.lit(found.inside).cast("long").alias("w")).where("w > 0")
    j = across.union(copies).select("j", "same", "w", F.explode(F.array(*map(F.lit, (32, 64, 128)))).alias("k"))
    hit = F.aggregate(F.slice("same", F.lit(1), F.col("k")), F.lit(0), lambda s, x: s + x) / F.col("k")
    mean = lambda x: F.round(F.sum(x * F.col("w")) / F.sum("w"), 6)
    return j.groupBy(F.col("k").cast("long").alias("k")).agg(F.sum("w").alias("n"), mean(F.abs(hit - F.col("j"))).alias("mean_abs_err"), mean(F.sqrt(F.col("j") * (1 - F.col("j")) / F.col("k"))).alias("theory"))


_WIDE = f"{_sig_sql(WIDE)}, c as (select doc_id, count(*) n from sh group by 1), i as (select x.doc_id a, y.doc_id b, count(*) inter from sh x join sh y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2), pairs as materialized (select a, b, inter, p.n + q.n - inter uni from i join c p on p.doc_id = a join c q on q.doc_id = b where inter >= 0.7 * (p.n + q.n - inter))"
add("minhash_error_wide", _error_wide, f"with {_WIDE}, k as (select unnest([32, 64, 128])::bigint k), s as (select k, a, b, inter / uni::double j, count(*) filter (where u.h = v.h) same from pairs join sig u on u.doc_id = a join sig v on v.doc_id = b and u.i = v.i join k on u.i < k group by all) select k, count(*) n, round(avg(abs(same / k::double - j)), 6) mean_abs_err, round(avg(sqrt(j * (1 - j) / k)), 6) theory from s group by 1")


def _lsh_wide(spark, d):
    """Candidates of three configurations of 128 permutations, verified against the exact pairs, and the candidates a document has to compare."""
    n, out = docs(spark, d).count(), D.lsh_counts(docs(spark, d), WIDE, CONFIGS, 0.7)
    share = lambda x: F.when(F.col(x) > 0, F.col("hits") / F.col(x)).otherwise(0.0)
    return out.select("*", share("candidates").alias("precision"), share("truth").alias("recall"), (F.col("candidates") / F.lit(n)).alias("per_document"))


add(
    "lsh_wide", _lsh_wide,
    f"with {_WIDE}, full_sig as materialized (select doc_id, p.i i, coalesce(h, 4294967295) h from documents cross join {_perm_sql(WIDE)} left join sig using (doc_id, i)), cfg as (select unnest([8, 16, 32])::bigint bands), "
    "band as (select bands, doc_id, i // (128 // bands) band, string_agg(h::varchar, ',' order by i) key from full_sig cross join cfg group by 1, 2, 3), cand as materialized (select distinct x.bands, x.doc_id a, y.doc_id b from band x join band y on x.bands = y.bands and x.band = y.band and x.key = y.key and x.doc_id < y.doc_id), "
    "m as (select cfg.bands, (select count(*) from cand where cand.bands = cfg.bands) candidates, (select count(*) from pairs) truth, (select count(*) from cand join pairs using (a, b) where cand.bands = cfg.bands) hits from cfg) "
    "select bands, candidates, truth, hits, case when candidates > 0 then hits::double / candidates else 0 end \"precision\", case when truth > 0 then hits::double / truth else 0 end recall, candidates::double / (select count(*) from documents) per_document from m",
)
