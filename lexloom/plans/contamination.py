"""Benchmark contamination: n-gram overlap in both directions, TF-IDF similarity, embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import words
from lexloom.operators import contamination as C
from lexloom.operators.neighbours import nearest
from lexloom.operators.shared import written
from lexloom.operators.windows import distinct_windows
from lexloom.plans.dialect import Plans
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add
NS = (5, 8, 13)
docs = lambda s, d: table(s, d, "documents")
bench = lambda s, d: table(s, d, "benchmark")


GRAMS_SQL = """{a}_w as (select {key}, regexp_extract_all(lower(text), '[a-z0-9'']+') w from {t}),
{a} as (select distinct {key}, unnest(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))) g from {a}_w where len(w) >= {n})"""


def grams_sql(a: str, t: str, key: str, n: int) -> str:
    return GRAMS_SQL.format(a=a, t=t, key=key, n=n)



def sides_sql(n: int) -> str:
    return f"{grams_sql('dg', 'documents', 'doc_id', n)}, {grams_sql('bg', 'benchmark', 'item_id', n)}"


def _docs(n: int):
    return lambda s, d: C.hits(docs(s, d), bench(s, d), n).select("doc_id", "g").distinct().groupBy("doc_id").agg(F.count("g").alias("n_grams"))


def items(n: int):
    """Items with the number of documents that share a gram."""

    def query(spark, d):
        found = C.hits(docs(spark, d), bench(spark, d), n).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))
        return bench(spark, d).select("item_id").join(found, "item_id", "left").select("item_id", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))

    return query


for _n in NS:
    add(f"contam_docs_{_n}", _docs(_n), f"with {sides_sql(_n)} select doc_id, count(*) n_grams from dg where g in (select g from bg) group by 1")
    add(f"contam_items_{_n}", items(_n), f"with {sides_sql(_n)}, h as (select item_id, count(distinct doc_id) n_docs from dg join bg using (g) group by 1) select item_id, coalesce(n_docs, 0) n_docs from benchmark left join h using (item_id)")
add("remove_contamination", lambda s, d: C.without_contaminated(docs(s, d), bench(s, d), 8).select("doc_id", F.md5("text").alias("text_md5")), f"with {sides_sql(8)} select doc_id, md5(text) text_md5 from documents where doc_id not in (select doc_id from dg where g in (select g from bg))")


def _union(rows):
    out = None
    for row in rows:
        out = row if out is None else out.union(row)
    return out


add(
    "contam_index_size", lambda s, d: distinct_windows(docs(s, d), NS),
    "with " + ", ".join(grams_sql(f"g{n}", "documents", "doc_id", n) for n in NS) + " " + " union all ".join(f"select {n}::bigint n, count(distinct g) grams from g{n}" for n in NS),
)


def _per_item(spark, d, n=8):
    all_ = C.grams(bench(spark, d), "item_id", n)
    found = C.hits(docs(spark, d), bench(spark, d), n).select("item_id", "g").distinct().withColumn("hit", F.lit(1))
    return all_.join(found, ["item_id", "g"], "left").groupBy("item_id").agg(F.count("*").alias("n_grams"), F.count("hit").alias("n_hit"))


def _overall(spark, d):
    """Item level: the share of items (those too short for a gram included) with a hit; token level: the share of the items' grams that the corpus has."""
    n = bench(spark, d).agg(F.count("*").alias("items"))
    per = _per_item(spark, d).agg(F.count_if(F.expr("n_hit > 0")).alias("hit_items"), F.sum("n_hit").alias("hit"), F.sum("n_grams").alias("grams"))
    return per.crossJoin(n).select("items", "hit_items", (F.col("hit_items") / F.col("items")).alias("item_rate"), (F.col("hit") / F.col("grams")).alias("gram_rate"))


_RATES = f"with {sides_sql(8)}, f as (select distinct g from dg), r as (select item_id, count(*) n_grams, count(f.g) n_hit from bg left join f using (g) group by 1)"
add("contam_rates", lambda s, d: _per_item(s, d).withColumn("share", F.col("n_hit") / F.col("n_grams")), _RATES + " select item_id, n_grams, n_hit, n_hit::double / n_grams share from r")
add("contam_overall_rates", _overall, _RATES + ", n as (select count(*) items from benchmark) select items, hit_items, hit_items::double / items item_rate, hit::double / grams gram_rate from n cross join (select count(*) filter (where n_hit > 0) hit_items, sum(n_hit) hit, sum(n_grams) grams from r) x")


def _sweep(spark, d):
    """By n: items flagged, documents flagged that hold no item's middle (false positives of short grams), and the index's size."""
    clean = written(_docs(13)(spark, d).select("doc_id"))

    def row(n):
        flagged = items(n)(spark, d).agg(F.count_if(F.col("n_docs") > 0).alias("flagged"), F.count("*").alias("items"))
        false = _docs(n)(spark, d).join(clean, "doc_id", "left_anti").agg(F.count("*").alias("clean_docs_flagged"))
        return flagged.crossJoin(false).crossJoin(C.distinct_grams(bench(spark, d), n)).select(F.lit(n).cast("long").alias("n"), "flagged", "items", (F.col("flagged") / F.col("items")).alias("rate"), "clean_docs_flagged", F.col("grams").alias("index_grams"))

    return _union(map(row, NS))


add(
    "contam_sweep", _sweep,
    "with " + ", ".join(f"{grams_sql(f'd{n}', 'documents', 'doc_id', n)}, {grams_sql(f'b{n}', 'benchmark', 'item_id', n)}" for n in NS)
    + ", r as (" + " union all ".join(f"select {n}::bigint n, (select count(distinct item_id) from b{n} where g in (select g from d{n})) flagged, (select count(distinct doc_id) from d{n} where g in (select g from b{n}) and doc_id not in (select doc_id from d13 where g in (select g from b13))) clean_docs_flagged, (select count(distinct g) from b{n}) index_grams" for n in NS)
    + ") select n, flagged, (select count(*) from benchmark) items, flagged::double / (select count(*) from benchmark) rate, clean_docs_flagged, index_grams from r",
)
add(
    "contam_short_items", lambda s, d: _per_item(s, d).join(bench(s, d).select("item_id", F.size(words(F.col("text"))).cast("long").alias("n_words")), "item_id", "right").select("item_id", "n_words", (F.col("n_words") < 13).alias("blind_at_13"), (F.col("n_words") < 8).alias("blind_at_8"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("flagged_at_8")),
    f"with {sides_sql(8)}, h as (select distinct item_id from bg where g in (select g from dg)) select item_id, SIZE(WORDS(text)) n_words, SIZE(WORDS(text)) < 13 blind_at_13, SIZE(WORDS(text)) < 8 blind_at_8, item_id in (select item_id from h) flagged_at_8 from benchmark",
)
both("contam_whitespace_rate", """with bw as (select item_id, WSWORDS(text) w from benchmark), bg as (select distinct item_id, JOINED(PIECE(w, i, 8), ' ') g from (select item_id, w, EACH(SEQ(1, SIZE(w) - 7)) i from bw where SIZE(w) >= 8) x),
dw as (select doc_id, WSWORDS(text) w from documents), dg as (select distinct JOINED(PIECE(w, i, 8), ' ') g from (select doc_id, w, EACH(SEQ(1, SIZE(w) - 7)) i from dw where SIZE(w) >= 8) x),
h as (select distinct item_id from bg join dg on bg.g = dg.g) select count(*) hit, DBL(count(*)) / max(n) rate from h cross join (select count(*) n from benchmark) b""".replace("PIECE(w, i, 8)", "PIECE(w, i, i + 7)"), """with bw as (select item_id, WSWORDS(text) w from benchmark), bg as (select distinct item_id, JOINED(PIECE(w, i, 8), ' ') g from (select item_id, w, explode(sequence(1, size(w) - 7)) i from bw where size(w) >= 8) x),
dw as (select doc_id, WSWORDS(text) w from documents), dg as (select JOINED(PIECE(w, i, 8), ' ') g from (select doc_id, w, explode(sequence(1, size(w) - 7)) i from dw where size(w) >= 8) x),
h as (select distinct item_id from bg left semi join dg on bg.g = dg.g) select count(*) hit, DBL(count(*)) / max(n) rate from h cross join (select count(*) n from benchmark) b""")


def _recall_by_group(spark, d):
    """Items whose whole text (words in lower case) a document holds, by group of length, and how many of them the 13-gram join flags."""
    flagged = items(13)(spark, d).where("n_docs > 0").select("item_id").withColumn("flag", F.lit(1))
    cut = lambda df, k: df.select(k, F.concat(F.lit(" "), F.array_join(words(F.col("text")), " "), F.lit(" ")).alias("t"))
    near = C.hits(docs(spark, d), bench(spark, d), 5).select("doc_id", "item_id").distinct()  # a verbatim copy shares its five-word windows
    b, t = cut(bench(spark, d), "item_id"), cut(docs(spark, d), "doc_id").withColumnRenamed("t", "u")
    leaked = near.join(b, "item_id").join(t, "doc_id").where(F.expr("contains(u, t)")).select("item_id").distinct()
    group = (F.size(words(F.col("text"))) < 30).alias("short_item")
    rows = bench(spark, d).select("item_id", group).join(leaked, "item_id").join(flagged, "item_id", "left")
    return rows.groupBy("short_item").agg(F.count("*").alias("n"), (F.count("flag") / F.count("*")).alias("recall"))


add(
    "contam_recall_by_group", _recall_by_group,
    f"with {sides_sql(13)}, h as (select distinct item_id from bg where g in (select g from dg)), b as (select item_id, len(WORDS(text)) < 30 short_item, ' ' || array_to_string(WORDS(text), ' ') || ' ' t from benchmark where len(WORDS(text)) >= 5), d as (select ' ' || array_to_string(WORDS(text), ' ') || ' ' u from documents), "
    "l as (select distinct item_id, short_item from b join d on contains(u, t)) select short_item, count(*) n, DBL(count(*) filter (where item_id in (select item_id from h))) / count(*) recall from l group by 1",
)
both("canary_hits", "select doc_id from documents where contains(lower(text), 'canary guid')")
both("bloom_sizing", "select n, BIG(ceil(-n * LN(p) / (LN(2) * LN(2)))) bits, R6(-LN(p) / LN(2)) hashes from (values (1000000, 0.01e0), (1000000000, 0.01e0), (1000000000, 0.001e0)) v(n, p)")

_TFIDF = """with n as (select DBL(count(*)) n from documents),
dt as (select doc_id, term, count(*) tf from (select doc_id, EACH(WORDS(text)) term from documents) t group by doc_id, term),
bt as (select item_id, term, count(*) tf from (select item_id, EACH(WORDS(text)) term from benchmark) t group by item_id, term),
idf as (select term, LN(max(n) / (1 + count(*))) + 1 idf from dt cross join n group by term),
dw as (select doc_id, dt.term, (1 + LN(tf)) * idf w from dt join idf on dt.term = idf.term),
bw as (select item_id, bt.term, (1 + LN(tf)) * coalesce(idf, LN(n) + 1) w from bt cross join n left join idf on bt.term = idf.term),
dn as (select doc_id, sqrt(sum(w * w)) s from dw group by doc_id), bn as (select item_id, sqrt(sum(w * w)) s from bw group by item_id),
dot as (select item_id, doc_id, sum(bw.w * dw.w) dot from bw join dw on bw.term = dw.term group by item_id, doc_id),
cos as (select dot.item_id, dot.doc_id, R6(dot / (bn.s * dn.s)) c from dot join bn on dot.item_id = bn.item_id join dn on dot.doc_id = dn.doc_id)"""


def _idf(spark, d):
    n = docs(spark, d).agg(F.count("*").cast("double").alias("n"))
    return C.idf(C.term_counts(docs(spark, d), "doc_id"), n).select("term", F.round("idf", 6).alias("idf"))


def _max_cos(spark, d):
    return C.cosines(docs(spark, d), bench(spark, d), best=True).withColumnRenamed("c", "max_cos")


def _fuzzy(spark, d):
    """The threshold above every item that shares no eight words in a row with a document, and what it flags on both sides."""
    m = written(_max_cos(spark, d).join(items(8)(spark, d), "item_id").select(F.col("max_cos").alias("c"), (F.col("n_docs") > 0).cast("int").alias("leaked")))
    thr = m.where("leaked = 0").agg((F.max("c") + 1e-9).alias("thr"))
    return m.crossJoin(F.broadcast(thr)).groupBy("leaked").agg(F.count("*").alias("n"), F.min("c").alias("lo"), F.round(F.avg("c"), 6).alias("mean"), F.max("c").alias("hi"), F.count_if(F.expr("c >= thr")).alias("flagged"))


add("tfidf_idf", _idf, _TFIDF.split("dw as")[0].rstrip(" ,\n") + " select term, R6(idf) idf from idf")
add("tfidf_max_similarity", _max_cos, _TFIDF + " select item_id, max(c) max_cos from cos group by item_id")
add("fuzzy_threshold", _fuzzy, f"with {sides_sql(8)}, h8 as (select distinct item_id from bg where g in (select g from dg)), " + _TFIDF.removeprefix("with ") + ", m as (select item_id, max(c) c from cos group by item_id), g as (select c, case when item_id in (select item_id from h8) then 1 else 0 end leaked from m), t as (select max(c) + 1e-9 thr from g where leaked = 0) select leaked, count(*) n, min(c) lo, R6(avg(c)) mean, max(c) hi, COUNT_IF(c >= thr) flagged from g cross join t group by leaked")


def _neighbours(spark, d):
    e = table(spark, d, "embeddings")
    return nearest(e, e, "vec_id", "embedding", 3)


add("embedding_neighbours", _neighbours, "with p as (select a.vec_id a, b.vec_id b, R6(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double))) dot from embeddings a join embeddings b on a.vec_id <> b.vec_id), r as (select a, b, dot, row_number() over (partition by a order by dot desc, b) rn from p) select a, b, dot from r where rn <= 3")
