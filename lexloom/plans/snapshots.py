"""Marked blocks, byte-level pieces, long prompts and replicated mixes (T-13, T-14, S-18, S-21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import byte_level
from lexloom.functions.text import ws_words
from lexloom.operators import blocks as B
from lexloom.operators import bpe
from lexloom.operators import contexts as C
from lexloom.plans.dialect import Plans
from lexloom.plans.tokens import CHUNKS
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add
docs = lambda s, d: table(s, d, "documents")

# T-13: reports of a hundred events each, with a block of every event's properties; some spelt otherwise, some stale, broken or of no record


def _reports(spark, d):
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    i, name = F.col("event_id"), F.concat(F.lit("event-"), F.col("event_id").cast("string"))
    body = F.when(i % 11 == 0, F.concat(F.lit('{"k": '), "k")).when(i % 7 == 0, F.concat(F.lit('{"k": '), (F.col("k").cast("long") + 1).cast("string"), F.lit("}"))).when(i % 3 == 0, F.concat(F.lit('{\n  "k" :'), "k", F.lit("\n}"))).otherwise(F.concat(F.lit('{"k":'), "k", F.lit("}")))
    name = F.when(i % 13 == 0, F.concat(name, F.lit("-gone"))).otherwise(name)
    block = F.concat(F.lit("Event.\n"), B.rendered(name, body), F.lit("\n"))
    rows = e.select(F.expr("event_id div 100").alias("doc_id"), F.struct("event_id", block.alias("b")).alias("x"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("text"))


def _records(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("event-"), F.col("event_id").cast("string")).alias("name"), F.col("props").alias("json"))


_STATES = "select IDIV(event_id, 100) doc_id, row_number() over (partition by IDIV(event_id, 100) order by event_id) - 1 place, concat('event-', event_id, case when event_id % 13 = 0 then '-gone' else '' end) name, case when event_id % 13 = 0 then 'unknown' when event_id % 11 = 0 then 'malformed' when event_id % 7 = 0 then 'stale' else 'current' end state from events"
add("stale_blocks", lambda s, d: B.states(_reports(s, d), _records(s, d)), _STATES)


def _refreshed(spark, d):
    """The texts after all blocks were made fresh: how many were, and the states that are left."""
    fresh = B.refreshed(_reports(spark, d), _records(spark, d))
    left = B.states(fresh, _records(spark, d)).groupBy("doc_id").agg(F.count_if(F.col("state") == "current").alias("n_current"), F.count_if(F.col("state") == "unknown").alias("n_unknown"), F.count("*").alias("n"))
    return fresh.select("doc_id", "n_refreshed").join(left, "doc_id")


add("refreshed_blocks", _refreshed, f"with s as ({_STATES}) select doc_id, count(*) filter (where state in ('stale', 'malformed')) n_refreshed, count(*) filter (where state <> 'unknown') n_current, count(*) filter (where state = 'unknown') n_unknown, count(*) n from s group by 1")


# T-14: chunks of the corpus as a byte-level vocabulary writes them, and back


def _byte_level(spark, d):
    c = bpe.chunk_counts(docs(spark, d)).select("chunk", byte_level.encoded(F.col("chunk")).alias("piece"))
    back = c.select("chunk", "piece", byte_level.decoded(F.col("piece")).alias("raw"))
    return back.groupBy(byte_level.script_of(F.col("raw")).alias("script")).agg(F.count("*").alias("n"), F.sum(F.length("piece")).alias("n_bytes"), F.count_if(F.col("raw") == F.encode("chunk", "UTF-8")).alias("n_back"))


_SCRIPT = "case " + " ".join(f"when regexp_matches(chunk, '\\p{{{s}}}') then '{s.lower()}'" for s in byte_level.SCRIPTS) + " when regexp_matches(chunk, '\\p{Nd}') then 'digits' else 'other' end"
add("byte_level_chunks", _byte_level, f"with {CHUNKS} select {_SCRIPT} script, count(*) n, sum(strlen(chunk))::bigint n_bytes, count(*) n_back from c group by 1")


def _vocabulary(spark, d, size=320):
    """The vocabulary trained on the corpus, written in the alphabet, decoded and counted by script; pieces of bytes that are no whole characters are `partial`."""
    merges = bpe.train(bpe.chunk_counts(docs(spark, d)), size)
    chars = byte_level.alphabet()
    rows = [(i, "".join(chars[b] for b in raw)) for i, raw in enumerate(bpe.Codec(merges).bytes_of)]
    pieces = spark.createDataFrame(rows, "id long, piece string").withColumn("raw", byte_level.decoded(F.col("piece")))
    return pieces.groupBy(byte_level.script_of(F.col("raw")).alias("script")).agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).alias("n_bytes"), F.max(F.octet_length("raw")).alias("longest"))


add("byte_level_vocabulary", _vocabulary)

# S-21: prompts of whole contexts with a needle; the reader sees the last words only
LENGTHS, FRACTIONS, WINDOW, NEEDLE = [500, 2000, 8000], [0.0, 0.25, 0.5, 0.75, 1.0], 1200, "the needle is 7421"
_CONTEXTS = "w as (select doc_id, WSWORDS(text) w from documents), e as (select unnest(w) word, doc_id, generate_subscripts(w, 1) i from w), p as (select word, row_number() over (order by doc_id, i) - 1 place from e), l as (select unnest([500, 2000, 8000])::bigint length), t as (select sum(len(w)) total from w), "
add(
    "needle_contexts", lambda s, d: C.contexts(docs(s, d), LENGTHS).select("length", "context", F.md5(F.array_join("words", " ")).alias("words_md5")),
    f"with {_CONTEXTS} c as (select length, place // length context, string_agg(word, ' ' order by place) x from p cross join l, t where place < total // length * length group by 1, 2) select length, context::bigint context, md5(x) words_md5 from c",
)


def _needles(spark, d):
    prompts = C.needled(C.contexts(docs(spark, d), LENGTHS), F.lit(NEEDLE), FRACTIONS)
    judged = C.searched(prompts, F.lit(NEEDLE), WINDOW)
    n = judged.groupBy("length").agg(F.count_distinct("context").alias("n_contexts"))
    return C.heat_map(judged, FRACTIONS).join(n, "length")


add(
    "needle_heatmap", _needles,
    f"with t as (select BIG(sum(SIZE(WSWORDS(text)))) total from documents), l as (select unnest([500, 2000, 8000])::bigint length), g as (select length, total // length n_contexts, f, floor(length * f)::bigint place from l cross join t cross join (values (0.0e0), (0.25e0), (0.5e0), (0.75e0), (1.0e0)) v(f) where total >= length) "
    f"select length, n_contexts, {', '.join(f'max(case when f = {f}e0 then (place + 1 > length + 1 - {WINDOW})::int::double end) p{round(100 * f)}' for f in FRACTIONS)} from g group by 1, 2",
)

# S-18: sources repeated to their targets
_TARGETS = "with s as (select source, BIG(sum(SIZE(WSWORDS(text)))) available, BIG(max(SIZE(WSWORDS(text)))) largest from documents group by source), t as (select source, available, largest, 1 + row_number() over (order by source) % 3 weight from s), u as (select source, available, largest, DBL(weight) / sum(weight) over () * sum(available) over () target from t) "
both("_targets", _TARGETS + "select source, target, largest from u")
_targets = QUERIES.pop("_targets")
ORACLES.pop("_targets")


def _replicas(spark, d):
    """Per source: rows and words of the replicated mix, and whether they are within one document of the target."""
    plan = _targets(spark, d)
    sized = docs(spark, d).select("doc_id", "source", F.size(ws_words(F.col("text"))).cast("long").alias("n_words"))
    out = C.replicated(sized, plan, "n_words").groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_words").alias("n_words"), F.max("epoch").cast("long").alias("epochs"))
    return out.join(plan, "source").select("source", "n_rows", "n_words", "epochs", F.col("n_words").between(F.col("target"), F.col("target") + F.col("largest")).alias("near"))


add(
    "mixture_replicas", _replicas,
    _TARGETS + ", d as (select source, SIZE(WSWORDS(text)) n, coalesce(sum(SIZE(WSWORDS(text))) over (partition by source order by H32(cast(doc_id as varchar)), doc_id rows between unbounded preceding and 1 preceding), 0) start from documents), "
    "c as (select d.source, n, floor(target / available)::bigint + case when start < target - floor(target / available) * available then 1 else 0 end copies from d join u on u.source = d.source) select source, sum(copies)::bigint n_rows, sum(n * copies)::bigint n_words, max(copies) epochs, true near from c group by 1",
)
