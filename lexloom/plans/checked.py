"""Candidates verified, recall against the ideal, full feature vectors, checked answers, markdown links (D, Q, R, P and G rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions.text import held, md5_bucket, words
from lexloom.operators import dedup as D
from lexloom.operators import markdown as K
from lexloom.operators import paraphrase as G
from lexloom.operators import sql_rewards as S
from lexloom.plans.dedup import BANDS, COMPONENTS, FULL, PERMS, _labels, _sig_sql
from lexloom.plans.dialect import Plans
from lexloom.plans.texts import EMAIL, IPV4, PHONE, SSN, STOPWORDS, STREET
from lexloom.plans.tokens import _SCORE
from lexloom.plans.tokens import QUERIES as TOKENS
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add
docs = lambda s, d: table(s, d, "documents")


# D-02: what exact deduplication removes of what one survivor a component would
def _exact_recall(spark, d):
    worded = docs(spark, d).where(F.size(words(F.col("text"))) > 0).select("doc_id", F.sha2("text", 256).alias("h"))
    comps = _labels(spark, d).join(worded, "doc_id").agg(F.count("*").alias("n"), F.count_distinct("component").alias("components"), F.count_distinct("h").alias("texts"))
    return comps.select((F.col("n") - F.col("texts")).alias("removed"), (F.col("n") - F.col("components")).alias("removable"), ((F.col("n") - F.col("texts")) / F.greatest(F.col("n") - F.col("components"), F.lit(1))).alias("recall"))


add("exact_dedup_of_ideal", _exact_recall, f"with recursive {COMPONENTS}, x as (select count(*) n, count(distinct component) c, count(distinct sha256(text)) t from comp join documents using (doc_id) join w using (doc_id) where len(w) > 0) select n - t removed, n - c removable, (n - t)::double / greatest(n - c, 1) recall from x")

# D-13: candidates of banding, verified exactly
add(
    "lsh_verified",
    lambda s, d: D.lsh_pairs(docs(s, d), PERMS, 4, 4, 0.7),
    f"with {_sig_sql(PERMS)}, {FULL}, {BANDS.format(r=4)}, c as (select doc_id, count(*) n from sh group by 1), i as (select a, b, count(*) inter from cand join sh x on x.doc_id = a join sh y on y.doc_id = b and x.g = y.g group by 1, 2) select a, b, inter, p.n + q.n - inter uni from i join c p on p.doc_id = a join c q on q.doc_id = b where inter >= 0.7 * (p.n + q.n - inter)",
)

# D-23: 64 bits, distance 3
_H = "h as (select doc_id, ('0x' || substr(md5(w), 1, 8))::bigint lo, ('0x' || substr(md5(w), 9, 8))::bigint hi from (select doc_id, unnest(WORDS(text)) w from documents))"
_BITS = " + ".join(f"case when sum(case when ({'lo' if b < 32 else 'hi'} >> {b % 32}) & 1 = 1 then 1 else -1 end) > 0 then {(1 << b) if b < 63 else -(1 << 63)}::hugeint else 0 end" for b in range(64))
_SIM64 = f"{_H}, s as materialized (select doc_id, ({_BITS})::bigint simhash from h group by 1)"
add("simhash64", lambda s, d: D.simhash(docs(s, d)), f"with {_SIM64} select doc_id, simhash from s")
add("simhash64_pairs", lambda s, d: D.hamming_pairs(D.simhash(docs(s, d)), "doc_id", "simhash", 64, 3), f"with {_SIM64} select x.doc_id a, y.doc_id b, bit_count(xor(x.simhash, y.simhash))::bigint distance from s x join s y on x.doc_id < y.doc_id and bit_count(xor(x.simhash, y.simhash)) <= 3")

# D-24: mean score by kind of copy
add(
    "mirror_scores", lambda s, d: D.copy_kinds(docs(s, d)).join(TOKENS["quality_score_fixed"](s, d), "doc_id").groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score")),
    _SCORE + ", k as (select doc_id, case when doc_id = min(doc_id) over t then 'original' when source is not distinct from first_value(source) over (partition by text order by doc_id) then 'copy' else 'mirror' end kind from documents window t as (partition by text)) select kind, count(*) n, R6(avg(score)) mean_score from k join s on s.doc_id = k.doc_id group by 1",
)


# Q-01: hashed word counts of length one, and eight features
def _vectors(spark, d):
    w = held(docs(spark, d).select("doc_id", "text"), "w", words(F.col("text")))
    n = lambda c: F.greatest(F.lit(1), c).cast("double")
    share = lambda pattern: F.regexp_count("text", F.lit(pattern)) / n(F.length("text"))
    stop = sorted(set(STOPWORDS["en"].split()))
    features = w.select(
        "doc_id", share("[A-Z]").alias("upper_ratio"), share("[0-9]").alias("digit_ratio"), (F.least(F.lit(12.0), F.length(F.array_join("w", "")) / n(F.size("w"))) / 12).alias("mean_word"), F.least(F.lit(1.0), 100 * share("!")).alias("bangs"),
        (F.size(F.filter("w", lambda x: x.isin(stop))) / n(F.size("w"))).alias("stop_ratio"), (F.size(F.array_distinct("w")) / n(F.size("w"))).alias("distinct_ratio"), share("[#*$%&|<>]").alias("symbols"), (F.size(F.filter("w", lambda x: x.rlike("^[a-z]+$"))) / n(F.size("w"))).alias("alpha_ratio"),
    )
    counts = w.select("doc_id", F.explode("w").alias("x")).groupBy("doc_id", (md5_bucket(F.col("x")) % 512).alias("bucket")).agg(F.count("*").alias("n"))
    vector = counts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))  # 512 at most
    out = features.join(vector, "doc_id", "left")
    return out.select("*", F.transform("b", lambda x: x["bucket"]).alias("buckets"), F.transform("b", lambda x: F.round(x["n"] / F.col("norm"), 9)).alias("values")).drop("b", "norm")


_STOP = ", ".join(f"'{x}'" for x in sorted(set(STOPWORDS["en"].split())))
add(
    "quality_vectors", _vectors,
    "with t as (select doc_id, text, WORDS(text) w from documents), c as (select doc_id, H32(e) % 512 bucket, count(*) n from (select doc_id, unnest(w) e from t) group by 1, 2), v as (select doc_id, sqrt(sum(n * n)::double) norm from c group by 1), "
    "a as (select c.doc_id, list(bucket order by bucket) buckets, list(round(n / norm, 9) order by bucket) \"values\" from c join v on v.doc_id = c.doc_id group by 1) "
    "select t.doc_id, COUNT_RE(text, '[A-Z]')::double / greatest(1, length(text)) upper_ratio, COUNT_RE(text, '[0-9]')::double / greatest(1, length(text)) digit_ratio, least(12.0e0, length(array_to_string(w, ''))::double / greatest(1, len(w))) / 12 mean_word, least(1.0e0, 100 * (COUNT_RE(text, '!')::double / greatest(1, length(text)))) bangs, "
    f"len(list_filter(w, lambda x: x in ({_STOP})))::double / greatest(1, len(w)) stop_ratio, len(list_distinct(w))::double / greatest(1, len(w)) distinct_ratio, COUNT_RE(text, '[#*$%&|<>]')::double / greatest(1, length(text)) symbols, len(list_filter(w, lambda x: regexp_matches(x, '^[a-z]+$')))::double / greatest(1, len(w)) alpha_ratio, buckets, \"values\" from t left join a on a.doc_id = t.doc_id",
)

# T-06 with addresses, G-04 with fillers and openers
_MASKS = ((EMAIL, "<EMAIL>"), (IPV4, "<IP>"), (PHONE, "<PHONE>"), (SSN, "<SSN>"), (STREET, "<ADDRESS>"))
_masked = "text"
for _pattern, _mark in _MASKS:
    _masked = f"REPLACE_ALL({_masked}, '{_pattern}', '{_mark}')"
both("pii_masked_addresses", f"select doc_id, md5({_masked}) masked_md5 from documents")
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_SAME = "case lower(w) " + " ".join(f"when '{a}' then '{b}'" for a, b in G.SYNONYMS.items()) + " else w end"
add(
    "paraphrases", lambda s, d: G.paraphrased(table(s, d, "benchmark"), "item_id"),
    f"with t as (select item_id, WSWORDS(text) w, H32(item_id::varchar) h from benchmark), g as (select *, {list(G.GAPS)}[h % 3 + 1] gap from t), b as (select item_id, h, array_to_string(flatten(list_transform(w, lambda w, i: case when i % gap = 0 then [{_SAME}, {_list(G.FILLERS)}[(h + (i - 1) // gap) % {len(G.FILLERS)} + 1]] else [{_SAME}] end)), ' ') body from g) select item_id, case when body = '' then '' else {_list(G.OPENERS)}[h % {len(G.OPENERS)} + 1] || ' ' || body end paraphrase from b",
)


# R-01, T-11: the pages as markdown files of one folder, each with a link to a heading of its own that every other page lacks
def _markdown(spark, d):
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""), "[?#].*$", ""), "[^A-Za-z0-9._-]", "-")
    title = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    links = F.transform(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)">[^<]*</a>'), F.lit(1)), lambda x: F.concat(F.lit("- [to]("), F.regexp_replace(x, "[^A-Za-z0-9._-]", "-"), F.lit(")")))
    own = F.concat(F.lit("[own](#"), F.when(F.col("page_id") % 2 == 0, K.slug(title)).otherwise("no-such-heading"), F.lit(")"))
    text = F.concat_ws("\n", F.concat(F.lit("# "), title), own, F.array_join(links, "\n"), F.lit("```\n[in a fence](nowhere)\n```"))
    return table(spark, d, "pages").select("page_id", F.concat(name, F.lit(".md")).alias("path"), text.alias("text"))


_MD = r"""f as (select page_id, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/?', ''), '[?#].*$', ''), '[^A-Za-z0-9._-]', '-', 'g') || '.md' path, html from pages),
l as (select distinct path, regexp_replace(x, '[^A-Za-z0-9._-]', '-', 'g') target from (select path, unnest(regexp_extract_all(html, '<a href="/([^"]*)">[^<]*</a>', 1)) x from f))"""
add("markdown_targets", lambda s, d: _markdown(s, d).select("page_id", F.size(K.targets(F.col("text"))).cast("long").alias("n_targets"), F.size(K.headings(F.col("text"))).cast("long").alias("n_headings")), f"with {_MD} select page_id, 1 + len(regexp_extract_all(html, '<a href=\"/([^\"]+)\">[^<]*</a>')) n_targets, 1::bigint n_headings from f")
add(
    "markdown_broken_links", lambda s, d: K.broken_links(_markdown(s, d).withColumn("text", F.regexp_replace("text", r"\]\(([^#)]+)\)", "]($1.md)"))),
    f"with {_MD}, o as (select path, page_id % 2 = 1 bad from f), g as (select path, bool_and(true) from o where bad group by path) select path, target || '.md' target, 'no such file' problem from l where target <> '' and target || '.md' not in (select path from f) union all select path, '#no-such-heading', 'no such anchor' from g",
)


# P-26: the quantity of an order, answered in the right form, wrongly, without thinking, or with more text behind
def _answers(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("id")).agg(F.sum("l_quantity").cast("long").alias("truth"), F.array_join(F.array_sort(F.collect_list(F.col("l_quantity").cast("long"))), " + ").alias("terms"))
    said = F.col("truth") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)
    think = F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("<think>\n"), "terms", F.lit("\n</think>\n")))
    return lines.select("id", "truth", F.concat(think, F.lit("<answer>"), said.cast("string"), F.lit("</answer>"), F.when(F.col("id") % 11 == 0, F.lit(" done")).otherwise(F.lit("\n"))).alias("text"))


FORM = r"^<think>[\s\S]+</think>\s*<answer>\s*(-?[0-9]+)\s*</answer>\s*$"


def _answer_reward(spark, d):
    """1.1 for a right answer in form, 0.1 for the form alone, nothing otherwise."""
    found = F.regexp_extract("text", FORM, 1)
    return _answers(spark, d).select("id", F.when(found == "", 0.0).when(found.try_cast("long") == F.col("truth"), 1.1).otherwise(0.1).alias("reward"))


add("answer_reward", _answer_reward, "select l_orderkey::bigint id, case when l_orderkey % 5 = 0 or l_orderkey % 11 = 0 then 0.0e0 when l_orderkey % 7 = 0 then 0.1e0 else 1.1e0 end reward from lineitem group by l_orderkey")

# P-27: answers to one task, run over the tables
ANSWERS = [
    (1, "Here it is.\n```sql\nselect n_name, count(*) n from customer join nation on c_nationkey = n_nationkey group by n_name\n```"),
    (2, "```sql\nselect n.n_name, sum(1) from nation n join customer c on c.c_nationkey = n.n_nationkey group by n.n_name order by 2 desc;\n```"),
    (3, "```sql\nselect n_name, count(*) n from nation group by n_name\n```"),
    (4, "```sql\nselect n_name, cast(n_name as int) n from nation\n```"),
    (5, "```sql\nselect n_name, count(c_key) from nation join customers on c_key = n_key group by 1\n```"),
    (6, "```sql\nselect n_name count(*) frm nation\n```"),
    (7, "select n_name, count(*) from customer"),
    (8, "```sql\ndrop table nation\n```"),
    (9, None),
]


def _sql_rewards(spark, d):
    tables = {t: table(spark, d, t) for t in ("nation", "customer")}
    wanted = tables["customer"].join(tables["nation"], F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return S.rewards(spark, ANSWERS, wanted, tables)


add("sql_answers_run", _sql_rewards, "select id::bigint id, reward::double reward from (values (1, 1.0), (2, 1.0), (3, 0.7), (4, 0.5), (5, 0.3), (6, 0.1), (7, 0.0), (8, 0.1), (9, 0.0)) v(id, reward) where (select count(*) from customer) > 0")

# P-30: shares of clipped ratios and entropies over the steps of training
both("clip_history", "with t as (select IDIV(event_id, 1000) step, 0.5e0 + JSONK(props) / 100.0e0 ratio, event_type from events), n as (select step, event_type, count(*) n from t group by step, event_type), h as (select step, R6(-sum(DBL(n) / total * LN(DBL(n) / total))) entropy from (select step, n, sum(n) over (partition by step) total from n) x group by step), c as (select step, count(*) n, DBL(COUNT_IF(abs(ratio - 1) > 0.2e0 + 1e-9)) / count(*) clip_fraction, R6(avg(ratio)) mean_ratio from t group by step) select c.step, n, clip_fraction, mean_ratio, entropy from c join h on h.step = c.step")
