"""One query an operator, with production parameters, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lexloom.llm.common import table


def op1_token_counts(spark, d):
    from lexloom.llm.token_counts import token_counts

    return token_counts(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_repeat_removal(spark, d):
    from lexloom.llm.repeat_removal import without_repeats

    return without_repeats(table(spark, d, "documents"))


def op3_secret_scan(spark, d):
    from lexloom.llm.secret_scan import secrets

    return secrets(table(spark, d, "documents"))


def op4_decontamination(spark, d):
    from lexloom.llm.decontamination import decontaminate

    return decontaminate(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op5_pii(spark, d):
    from lexloom.llm.pii import personal

    return personal(table(spark, d, "documents"))


def op6_mixing(spark, d):
    from lexloom.llm.mixing import mix

    return mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_warc(spark, d):
    from lexloom.llm.warc import archive

    return archive(table(spark, d, "pages"))


def op8_license_scan(spark, d):
    """Documents have no paths: source and language make directories of 50 documents each, and a short text with a notice is its directory's LICENSE."""
    from lexloom.llm.license_scan import licenses

    notice = F.coalesce((F.length("text") < 600) & F.col("text").rlike("(?i)licen[cs]ed? under|released under"), F.lit(False))
    name = F.concat(F.when(notice, "LICENSE-").otherwise("text-"), F.col("doc_id").cast("string"))
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 50).cast("string"), name)
    return licenses(table(spark, d, "documents").withColumn("path", path))


def op9_quality_rules(spark, d):
    from lexloom.llm.quality_rules import quality, train

    docs = table(spark, d, "documents")
    return quality(docs, train(docs, table(spark, d, "labels")))


def op10_ngram_join(spark, d):
    from lexloom.llm.ngram_join import classes

    return classes(table(spark, d, "documents"))


def op11_collocations(spark, d):
    from lexloom.llm.collocations import collocations

    return collocations(table(spark, d, "documents"))


def op12_filter_audit(spark, d):
    from lexloom.llm.filter_audit import audit

    return audit(table(spark, d, "documents"), table(spark, d, "labels"))


def op13_packing(spark, d):
    from lexloom.llm.packing import pack_texts

    return pack_texts(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def pipeline(spark, d):
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries():
    return {f.__name__: f for f in (op1_token_counts, op2_repeat_removal, op3_secret_scan, op4_decontamination, op5_pii, op6_mixing, op7_warc, op8_license_scan, op9_quality_rules, op10_ngram_join, op11_collocations, op12_filter_audit, op13_packing, pipeline)}


#: DuckDB SQL of the queries that SQL can express; the others depend on trained models or on a tokenizer's merges, or are
#: too slow on whole tables (op2), and are tested against brute force.
OP6 = r"""with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 rank from d group by source),
w as (select *, (rank % 3 + 1)::double weight, 3.0e0 * source_size most from s),
o as (select *, sum(source_size) over ()::double - coalesce(sum(most) over (order by case when most > 0 then weight / most end desc nulls first, rank rows between unbounded preceding and 1 preceding), 0) lft,
  sum(weight) over (order by case when most > 0 then weight / most end desc nulls first, rank rows between current row and unbounded following) wl,
  row_number() over (order by case when most > 0 then weight / most end desc nulls first, rank) k from w),
l as (select arg_min(lft / wl, k) level from o where not lft / wl * weight > most),
t as (select source, source_size, least(most, level * weight) target from o cross join l),
r as (select d.*, t.source_size, t.target, coalesce(sum(size) over (partition by d.source order by ('0x' || substr(md5('17:' || doc_id), 1, 8))::bigint, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint start from d join t on d.source is not distinct from t.source),
e as (select *, case when source_size > 0 then floor(floor(target) / source_size)::bigint else 0 end epochs from r)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - start)))::bigint taken from e"""
OP7 = """with p as (select page_id, coalesce(html, '') html, strlen(coalesce(html, '')) n from pages), m as (select html, max(page_id) last from p where n >= 1000 group by 1)
select p.page_id, n::bigint payload_bytes, sha1(p.html) payload_digest, case when last > p.page_id then 'revisit' else 'response' end record_type, case when last > p.page_id then last end refers_to from p left join m on m.html = p.html"""
OP10 = r"""with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') w from documents),
sh as materialized (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from w),
c as materialized (select doc_id, count(*) n from sh group by 1), i as materialized (select x.doc_id a, y.doc_id b, count(*) k from sh x join sh y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
pairs as materialized (select a, b from i join c p on p.doc_id = a join c q on q.doc_id = b where 100 * k >= 80 * (p.n + q.n - k)), e as (select a, b from pairs union all select b, a from pairs),
r(doc_id, m) as (select doc_id, doc_id from documents union select e.b, r.m from r join e on r.doc_id = e.a and r.m < e.b)
select d.doc_id, coalesce(c.n, 0)::bigint n_shingles, l.m component_id from documents d left join c on c.doc_id = d.doc_id join (select doc_id, min(m) m from r group by 1) l on l.doc_id = d.doc_id"""

OP11 = r"""with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\v\f\r]')) piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^ \t]+') w from p), t as (select lang, sum(len(w))::bigint n from w group by 1),
g as (select lang, w[i:i + k - 1] g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from w cross join (values (1), (2), (3), (4)) x(k) where len(w) >= k)),
f as materialized (select lang, array_to_string(g, ' ') phrase, g, len(g) k, count(*) n from g group by lang, g having count(*) >= 30),
c as (select f.lang, f.phrase, f.n a, cut, array_to_string(f.g[1:cut], ' ') lft, array_to_string(f.g[cut + 1:], ' ') rgt from (select *, unnest(range(1, k)) cut from f where k >= 2) f),
s as (select c.lang, c.phrase, c.a, x.n l, y.n r, (2000000::hugeint * c.a // (x.n::hugeint + y.n))::bigint score, row_number() over (partition by c.lang, c.phrase order by 2000000::hugeint * c.a // (x.n::hugeint + y.n), cut) best from c join f x on x.lang = c.lang and x.phrase = c.lft join f y on y.lang = c.lang and y.phrase = c.rgt),
i as (select lang, array_to_string(g[i:i + m - 1], ' ') phrase, max(n) most from (select *, unnest(range(1, k - m + 2)) i from (select *, unnest(range(2, k)) m from f where k >= 3)) group by 1, 2),
r as (select s.lang, row_number() over (partition by s.lang order by score desc, s.a desc, s.phrase) "rank", s.phrase, s.a, l, r, score from s left join i on i.lang = s.lang and i.phrase = s.phrase where best = 1 and (most is null or 100::hugeint * most < 80::hugeint * s.a))
select r.lang, r."rank", r.phrase, r.a, r.l, r.r, t.n, r.score from r join t on t.lang = r.lang where r."rank" <= 2000"""
#: The five failure bits of each document, then every order of the filters against the cells.
OP12 = r"""with w as (select doc_id, coalesce(source, '') part, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') w, min(doc_id) over (partition by coalesce(text, '')) first from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by 1),
m as (select part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(first < w.doc_id, false)] fails, coalesce(good, 0) good, coalesce(toxic, 0) toxic from w left join l on l.doc_id = w.doc_id),
c as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from m group by 1, 2),
x as (select unnest(range(1, 6)) i), o as (select [a.i, b.i, c.i, d.i, e.i] o from x a, x b, x c, x d, x e where len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s as (select part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') filter_order, step, o[step] f, n, good, toxic, fails, coalesce(list_position(list_transform(o, lambda i: fails[i]), true), 6) hit, len(list_filter(fails, lambda b: b)) n_fails from c cross join o cross join (select unnest(range(1, 6)) step) t),
r as (select part, filter_order, step::int step, f, coalesce(sum(n) filter (where hit > step), 0)::bigint kept, coalesce(sum(n) filter (where hit = step), 0)::bigint removed, coalesce(sum(n) filter (where fails[f] and hit < step), 0)::bigint redundant, coalesce(sum(n) filter (where fails[f] and n_fails = 1), 0)::bigint unique_fails, coalesce(sum(good) filter (where hit = step), 0)::bigint good_lost, coalesce(sum(toxic) filter (where hit = step), 0)::bigint toxic_lost from s group by 1, 2, 3, 4)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint shapley from r"""


def op4_sql() -> str:
    from lexloom.llm.decontamination import COMMON_SHARE, MIN_LITERAL, TOKEN, UNITS, WINDOW

    units = ", ".join(f"'{u}'" for u in UNITS)
    kind = f"case when t[1] between '0' and '9' then '<num>' when t[1] <> lower(t)[1] and substr(t, 2, 1) = lower(substr(t, 2, 1)) then '<name>' when lower(t) in ({units}) then '<unit>' else lower(t) end"
    token = TOKEN.replace("'", "''")
    side = lambda a, k, t: (
        f"{a}0 as materialized (select {k}, w, list_transform(w, lambda t: {kind}) c from (select {k}, regexp_extract_all(coalesce(text, ''), '{token}') w from {t}) x where len(w) >= {WINDOW}), "
        f"{a} as materialized (select {k}, w[i:i + {WINDOW - 1}] w, c[i:i + {WINDOW - 1}] c from (select {k}, w, c, unnest(range(1, len(w) - {WINDOW - 2})) i from {a}0) x)"
    )
    return (
        f"with {side('d', 'doc_id', 'documents')}, {side('b', 'item_id', 'benchmark')}, "
        f"bs as (select distinct * from b where len(list_filter(c, lambda t: not starts_with(t, '<'))) >= {MIN_LITERAL}), "
        f"m as (select doc_id, item_id, list_distinct(list_filter(list_transform(range(1, {WINDOW + 1}), lambda i: [bs.c[i], lower(bs.w[i]), lower(d.w[i])]), lambda s: starts_with(s[1], '<'))) p from d join bs on d.c = bs.c), "
        "ok as (select doc_id, item_id, count(*) n from m where len(list_distinct(list_transform(p, lambda s: [s[1], s[2]]))) = len(p) and len(list_distinct(list_transform(p, lambda s: [s[1], s[3]]))) = len(p) group by 1, 2), "
        # case-folded windows, and items shorter than a window as one
        f"bt as materialized (select item_id, regexp_extract_all(coalesce(text, ''), '{token}') w from benchmark), "
        f"bl as (select item_id, list_transform(w, lambda t: lower(t)) f from (select distinct item_id, w from b) x union all select item_id, list_transform(w, lambda t: lower(t)) from bt where len(w) between 1 and {WINDOW - 1}), "
        f"dt as materialized (select doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{token}'), lambda t: lower(t)) w from documents), "
        "dl as (select doc_id, w[i:i + m - 1] f from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) i from dt cross join (select distinct len(f) m from bl) x where len(w) >= m)), "
        "fm as materialized (select doc_id, item_id, len(dl.f) m, count(*) n from dl join bl on dl.f = bl.f group by 1, 2, 3), "
        f"often as (select item_id from fm where m < {MIN_LITERAL} group by 1 having count(distinct doc_id) > greatest(1, {COMMON_SHARE} * (select count(*) from documents))), "
        "fl as (select doc_id, item_id, n from fm where item_id not in (select item_id from often)), "
        "both_ as (select coalesce(ok.doc_id, fl.doc_id) doc_id, coalesce(ok.item_id, fl.item_id) item_id, coalesce(ok.n, fl.n) n from ok full join fl on ok.doc_id = fl.doc_id and ok.item_id = fl.item_id), "
        "h as (select doc_id, sum(n)::bigint n_windows, list_sort(list(item_id)) items from both_ group by 1) "
        "select documents.doc_id, h.doc_id is not null contaminated, coalesce(n_windows, 0)::bigint n_windows, coalesce(items, []) items from documents left join h on h.doc_id = documents.doc_id"
    )


def oracle_sql():
    return {"op4_decontamination": op4_sql(), "op6_mixing": OP6, "op7_warc": OP7, "op10_ngram_join": OP10, "op11_collocations": OP11, "op12_filter_audit": OP12}
