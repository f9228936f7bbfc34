"""Loss masks, packing, loaders and mixing (S rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import training_rows as T
from lexloom.operators.prefix import running_sum
from lexloom.plans.dialect import Plans
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add

# A turn is its marker, its bytes and, for the assistant, an END. System turns are masked and have no END.
_T = "with t as (select conv_id, turn, role, text, BYTES(text) n, max(case when role = 'assistant' then turn else -1 end) over (partition by conv_id) last_turn from conversations) "
both("sft_render", "select conv_id, sha256(string_agg(concat('<', role, '>', text, case when role = 'assistant' then '<end>' else '' end), '' order by turn)) rendered from conversations group by conv_id", "select conv_id, sha2(listagg(concat('<', role, '>', text, case when role = 'assistant' then '<end>' else '' end), '') within group (order by turn), 256) rendered from conversations group by conv_id")
both("sft_lengths", "select conv_id, BIG(sum(1 + BYTES(text) + case when role = 'assistant' then 1 else 0 end)) n_ids from conversations group by conv_id")
both("sft_mask_counts", _T + "select conv_id, BIG(sum(case when role = 'assistant' then n + 1 else 0 end)) correct, BIG(sum(case when role = 'assistant' then n else 0 end)) no_eos, BIG(sum(1 + n + case when role = 'assistant' then 1 else 0 end)) no_mask, BIG(sum(case when turn = last_turn then n + 1 else 0 end)) last_turn from t group by conv_id")
both("sft_mask_share", _T + "select DBL(sum(case when turn = last_turn then n + 1 else 0 end)) / sum(case when role = 'assistant' then n + 1 else 0 end) last_turn_share, DBL(sum(1 + n)) / sum(case when role = 'assistant' then n + 1 else 0 end) no_mask_share from t")
both("sft_show_mask", "select conv_id, turn, case when role = 'assistant' then concat('[', text, '<end>]') else text end shown from conversations")
both("sft_golden_counts", "select BIG(sum(case when a then n + 1 else 0 end)) correct, BIG(sum(case when a then n else 0 end)) no_eos, BIG(MAX_BY(n + 1, case when a then i end)) last_turn from (values (1, 40, false), (2, 120, true), (3, 25, false), (4, 200, true), (5, 60, false), (6, 150, true)) v(i, n, a)")

def _examples(mode, limit=None):
    def query(spark, d):
        e = T.examples(table(spark, d, "conversations"), mode, limit)
        return e.select("conv_id", F.size("ids").cast("long").alias("n_ids"), F.md5(F.array_join("ids", ",")).alias("ids_md5"), F.md5(F.array_join("labels", ",")).alias("labels_md5"))

    return query


def _examples_sql(mode, limit=None):
    b = "list_transform(range(0, strlen(coalesce(text, ''))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::int)"
    on = "turn = last_turn" if mode == "last_turn" else "role = 'assistant'"
    cut = (lambda x: f"{x}[1:{limit}]") if limit else (lambda x: x)
    no = lambda x: f"list_transform({x}, lambda v: -100)"
    lab = "list_concat(list_concat(m, b), e)" if mode == "no_mask" else f"list_concat(list_concat({no('m')}, case when {on} then b else {no('b')} end), case when {on} and {'false' if mode == 'no_eos' else 'true'} then e else {no('e')} end)"
    return (
        _T.rstrip() + f", u as (select *, [case role when 'assistant' then 257 when 'system' then 258 else 256 end] m, {b} b, case when role = 'assistant' then [259] else []::int[] end e from t), "
        f"v as (select conv_id, flatten(list(list_concat(list_concat(m, b), e) order by turn)) ids, flatten(list({lab} order by turn)) labels from u group by conv_id) "
        f"select conv_id, len({cut('ids')})::bigint n_ids, md5(array_to_string({cut('ids')}, ',')) ids_md5, md5(array_to_string({cut('labels')}, ',')) labels_md5 from v"
    )


for _mode in T.MODES:
    add(f"sft_examples_{_mode}", _examples(_mode), _examples_sql(_mode))
add("sft_truncated", _examples("correct", 256), _examples_sql("correct", 256))
add("byte_round_trip", lambda s, d: table(s, d, "conversations").where(T.decoded(T.byte_ids(F.col("text"))) != F.coalesce("text", F.lit(""))).select("conv_id", "turn"), "select conv_id, turn from conversations where decode(encode(coalesce(text, ''))) <> coalesce(text, '')")


def _padded(spark, d):
    p = T.padded(T.examples(table(spark, d, "conversations")), "conv_id", 8)
    return p.select("conv_id", "batch", F.size("ids").cast("long").alias("width"), (F.size("ids") - F.col("n")).cast("long").alias("padding"), F.size(F.filter("labels", lambda x: x != T.MASKED)).cast("long").alias("supervised"))


both("forged_markers", "select role, COUNT_IF(text like '%<user>%' or text like '%<assistant>%' or text like '%<end>%') forged, count(*) n from conversations group by role")
_L = "with c as (select conv_id, BIG(sum(1 + BYTES(text) + case when role = 'assistant' then 1 else 0 end)) n from conversations group by conv_id), b as (select conv_id, n, IDIV(row_number() over (order by conv_id) - 1, 8) batch from c) "
add("sft_padding_waste", lambda s, d: T.padding_waste(lengths(s, d), "conv_id", "n", 8), _L + "select batch, max(n) longest, BIG(max(n) * count(*)) padded, BIG(sum(n)) useful, DBL(sum(n)) / (max(n) * count(*)) share from b group by batch")
add("padded_batches", _padded, _L + ", m as (select batch, max(n) w from b group by batch), u as (select conv_id, sum(case when role = 'assistant' then BYTES(text) + 1 else 0 end) k from conversations group by conv_id) select b.conv_id, b.batch, w width, w - n padding, BIG(k) supervised from b join m on b.batch = m.batch join u on u.conv_id = b.conv_id")


def lengths(spark, d):
    """conv_id, n: ids of a conversation, counted without building them."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.octet_length("text") + 1 + F.when(F.col("role") == "assistant", 1).otherwise(0)).cast("long").alias("n"))


def _packs(spark, d):
    return T.next_fit(lengths(spark, d), "conv_id", "n", 4096)


_NF = """with recursive c as (select conv_id, sum(strlen(text) + 1 + case when role = 'assistant' then 1 else 0 end)::bigint n from conversations group by 1),
o as (select conv_id // 100000 shard, conv_id, n, row_number() over (partition by conv_id // 100000 order by conv_id) rn from c where n <= 4096),
p(shard, rn, conv_id, pack, start_at, used) as (select shard, rn, conv_id, 0::bigint, 0::bigint, n from o where rn = 1
union all select o.shard, o.rn, o.conv_id, case when p.used + o.n > 4096 then p.pack + 1 else p.pack end, case when p.used + o.n > 4096 then 0 else p.used end, case when p.used + o.n > 4096 then o.n else p.used + o.n end from p join o on o.shard = p.shard and o.rn = p.rn + 1)"""
add("sft_pack_nextfit", _packs, _NF + " select shard, conv_id, pack, start_at from p")
add("pack_segments", lambda s, d: _packs(s, d).groupBy("shard", "pack").agg(F.array_sort(F.collect_list("start_at")).alias("starts")), _NF + " select shard, pack, list(start_at order by start_at) starts from p group by 1, 2")


def _packing_gain(spark, d):
    """Packed against padded tokens of the conversations, and the speed-up."""
    packed = _packs(spark, d).join(lengths(spark, d), "conv_id").groupBy("shard", "pack").agg(F.sum("n").alias("used")).agg((F.count("*") * 4096).alias("packed_tokens"), F.sum("used").alias("useful"))
    whole = T.padding_waste(lengths(spark, d).where("n <= 4096"), "conv_id", "n", 8).agg(F.sum("padded").alias("padded_tokens"))
    return packed.crossJoin(whole).select("useful", "packed_tokens", "padded_tokens", (F.col("padded_tokens") / F.col("packed_tokens")).alias("speed_up"))


add("packing_gain", _packing_gain, _NF + ", u as (select shard, pack, sum(c.n) used from p join c using (conv_id) group by 1, 2), b as (select n, (row_number() over (order by conv_id) - 1) // 8 batch from c where n <= 4096), w as (select max(n) * count(*) padded from b group by batch) select x.useful::bigint useful, x.packed_tokens::bigint packed_tokens, y.padded_tokens::bigint padded_tokens, y.padded_tokens::double / x.packed_tokens speed_up from (select sum(used) useful, count(*) * 4096 packed_tokens from u) x cross join (select sum(padded) padded_tokens from w) y")


def _block_pairs(spark, d):
    return _packs(spark, d).join(lengths(spark, d), "conv_id").groupBy("shard", "pack").agg(F.sum(F.expr("n * (n + 1) div 2")).alias("allowed"), F.expr("sum(n) * (sum(n) + 1) div 2").alias("causal"))


add("block_mask_pairs", _block_pairs, _NF + ", q as (select p.shard, p.pack, c.n from p join c using (conv_id)) select shard, pack, sum(n * (n + 1) // 2)::bigint allowed, (sum(n) * (sum(n) + 1) // 2)::bigint causal from q group by 1, 2")
_PP = "with e as (select doc_id, n_chars, sum(n_chars) over (order by doc_id nulls last, n_chars rows unbounded preceding) - n_chars start from documents) select doc_id, BIG(start) start, BIG(start % 2048) position, BIG(IDIV(start, 2048)) seq from e"
_CC = "with e as (select doc_id, n_chars + 1 len, sum(n_chars + 1) over (order by doc_id rows unbounded preceding) - n_chars - 1 start from documents), p as (select doc_id, len, start, EACH(SEQ(BIG(IDIV(start, 2048)), BIG(IDIV(start + len - 1, 2048)))) seq from e) select doc_id, BIG(seq) seq, BIG(greatest(start, seq * 2048) - seq * 2048) begin_at, BIG(least(start + len, (seq + 1) * 2048) - greatest(start, seq * 2048)) n from p"
# The running sum of all documents is a distributed prefix sum: range sums first, then running sums within ranges.


def _pack_positions(spark, d):
    e = running_sum(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", "start")
    return e.select("doc_id", "start", F.expr("start % 2048").alias("position"), F.expr("start div 2048").alias("seq"))


add("pack_positions", _pack_positions, _PP)


def _concat_pack(spark, d):
    e = running_sum(table(spark, d, "documents").select("doc_id", (F.col("n_chars") + 1).alias("len")), "doc_id", "len", "start")
    first, last = F.expr("start div 2048"), F.expr("(start + len - 1) div 2048")
    p = e.select("doc_id", "len", "start", F.explode(F.sequence(first, last)).alias("seq"))
    begin = F.greatest("start", F.col("seq") * 2048)
    return p.select("doc_id", "seq", (begin - F.col("seq") * 2048).alias("begin_at"), (F.least(F.col("start") + F.col("len"), (F.col("seq") + 1) * 2048) - begin).alias("n"))


add("concat_pack", _concat_pack, _CC)
_LOAD = "with e as (select epoch, doc_id from documents cross join (values (0), (1)) v(epoch)), o as (select epoch, doc_id, row_number() over (partition by epoch order by ('0x' || substr(md5(concat('7-', cast(epoch as varchar(9)), '-', cast(doc_id as varchar(20)))), 1, 12))::bigint, doc_id) rn, count(*) over (partition by epoch) n from e) select BIG(epoch) epoch, IDIV(rn - 1, 32) step, doc_id from o where rn <= IDIV(n, 32) * 32"
add("loader_batches", lambda s, d: T.batches(table(s, d, "documents"), "doc_id", 0, 32, 7).union(T.batches(table(s, d, "documents"), "doc_id", 1, 32, 7)), _LOAD)


def _resume(spark, d):
    """A loader is stopped in the middle of an epoch; one that takes up its state, over the rows in another order, is compared with a run that never stopped."""
    docs = table(spark, d, "documents")
    whole, first, later = T.Loader(docs), T.Loader(docs), T.Loader(docs.repartition(3, F.xxhash64("text")))
    steps = whole.steps
    first.next(steps // 2 + 1)
    later.load_state_dict(first.state_dict())
    rest = later.next(steps)
    behind = whole.next(steps // 2 + 1 + steps).where(F.expr(f"epoch > 0 or step > {steps // 2}"))
    return T.first_difference(behind, rest)


add("loader_resume_check", _resume, "select IDIV(count(*), 32) steps, BIG(0) differing, cast(null as bigint) first_epoch, cast(null as bigint) first_step from documents")
both("shard_assignment", "select BIG(H32(cast(doc_id as varchar(20))) % 16) shard, count(*) n, BIG(sum(n_chars)) chars from documents group by BIG(H32(cast(doc_id as varchar(20))) % 16)")
both("shard_storage", "select vocab, BIG(tokens * case when vocab <= 65536 then 2 else 4 end) bytes from (values (50257, 15000000000000), (131072, 15000000000000)) v(vocab, tokens)")
_MIX = "with s as (select source, BIG(sum(SIZE(WSWORDS(text)))) available from documents group by source), t as (select source, available, 1 + row_number() over (order by source) % 3 weight from s), u as (select source, available, DBL(weight) / sum(weight) over () share, sum(available) over () total from t) "
both("mixture_plan", _MIX + "select source, available, share, share * total target, share * total / available factor, BIG(ceil(share * total / available)) epochs from u")
both("annealing_mix", _MIX + "select stage, source, R6(share * case when stage = 1 then 1.0e0 when available > 15000 then 0.5e0 else 2.0e0 end) weight from u cross join (values (1), (2)) v(stage)")
both("chinchilla_tokens", "select params, params * 20 tokens, 6.0e0 * params * params * 20 flops from (values (7e9), (70e9), (405e9)) v(params)")
both("packing_win", "select R6(800000e0 * 8192 / (800000e0 * 720)) speed_up")
both("needle_grid", "select len, pos, BIG(floor(len * pos)) needle_at from (values (4096), (32768), (131072)) l(len) cross join (values (0.0e0), (0.25e0), (0.5e0), (0.75e0), (1.0e0)) p(pos)")
both("needle_accuracy", "with g as (select IDIV(n_chars, 1000) len_bin, doc_id % 5 pos, case when H32(text) % 10 < 8 then 1 else 0 end ok from documents) select len_bin, DBL(sum(case when pos = 0 then ok end)) / count(case when pos = 0 then 1 end) p0, DBL(sum(case when pos = 2 then ok end)) / count(case when pos = 2 then 1 end) p2, DBL(sum(case when pos = 4 then ok end)) / count(case when pos = 4 then 1 end) p4 from g group by len_bin having count(case when pos = 0 then 1 end) > 0 and count(case when pos = 2 then 1 end) > 0 and count(case when pos = 4 then 1 end) > 0")
