"""Closed-form cost models and discrete simulations (C rows); inputs are inline values or requests derived from documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.operators import costs as K
from lexloom.operators import serving as V
from lexloom.operators.prefix import ranked
from lexloom.plans.dialect import Plans
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add

LINKS = [("nvlink", 450.0, 2.0, 1.0), ("ib", 40.0, 5.0, 1.0), ("eth", 10.0, 15.0, 1.0), ("eth_over", 40.0, 15.0, 4.0)]


def given(spark, rows, schema, **lists):
    """Inline configurations, each with every value of the lists."""
    df = spark.createDataFrame(rows, schema)
    for name, values in lists.items():
        df = df.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return df


def links(spark, **lists):
    return given(spark, LINKS, "link string, gbps double, lat_us double, over double", **lists)


def over_link(f, *first):
    return F.round(f(*first, F.col("gbps"), F.col("lat_us"), F.col("over")), 6)


M = "m as (select * from (values ('small', 32, 4096e0, 32, 8, 128, 14336e0, 128256e0, 0, 0), ('large', 80, 8192e0, 64, 8, 128, 28672e0, 128256e0, 0, 0), ('moe', 61, 7168e0, 128, 128, 128, 2048e0, 129280e0, 256, 8)) v(model, layers, hidden, heads, kv, hd, ffn, vocab, experts, top_k))"
_PAR = f"with {M}, p as (select *, layers * (2 * hidden * heads * hd + 2 * hidden * kv * hd) attention, layers * 3 * hidden * ffn expert, 2 * vocab * hidden embedding from m) "
both("model_parameters", _PAR + "select model, attention, expert, embedding, attention + embedding + expert * greatest(1, experts) total, attention + embedding + expert * greatest(1, top_k) active from p")
both("kv_bytes", f"with {M} select model, scheme, layers * 2.0e0 * case scheme when 'mha' then heads when 'gqa' then kv when 'mqa' then 1 else 0 end * hd * 2 + case scheme when 'mla' then layers * 576 * 2.0e0 else 0 end bytes_per_token from m cross join (values ('mha'), ('gqa'), ('mqa'), ('mla')) s(scheme)")
both("kv_context_fit", f"with {M} select model, ctx, layers * 2.0e0 * kv * hd * 2 * ctx bytes, BIG(floor(40e9 / (layers * 2.0e0 * kv * hd * 2 * ctx))) sequences from m cross join (values (8192), (131072)) c(ctx)")
both("cache_prediction", "select layers, heads, hd, t, BIG(2) * layers * heads * hd * t * 2 bytes from (values (2, 4, 16, 64), (80, 8, 128, 4096)) v(layers, heads, hd, t)")
add("static_memory", lambda s, d: given(s, [("bf16_adam", 18.0), ("fp32_adam", 16.0), ("fp8_mix", 13.0), ("inference", 2.0)], "name string, bpp double", params=[7e9, 70e9]).select("name", "params", "bpp", F.round(K.static_memory_gb(F.col("params"), F.col("bpp")), 6).alias("gb")), "select name, params, bpp, R6(params * bpp / pow(2, 30)) gb from (values ('bf16_adam', 18e0), ('fp32_adam', 16e0), ('fp8_mix', 13e0), ('inference', 2e0)) v(name, bpp) cross join (values (7e9), (70e9)) p(params)")
both("activation_memory", "select recompute, flash, R6(layers * hidden * seq * batch * 2 * case recompute when 'none' then 16 when 'selective' then 5 else 1 end / pow(2, 30) + case when flash then 0 else layers * heads * seq * seq * batch * 2 / pow(2, 30) end) gb from (values (80e0, 8192e0, 4096e0, 64e0, 1e0)) v(layers, hidden, seq, heads, batch) cross join (values ('none'), ('selective'), ('full')) r(recompute) cross join (values (true), (false)) f(flash)")
_GRID = """g as (select tp, pp, dp, zero from (values (1), (2), (4), (8)) a(tp) cross join (values (1), (2), (4), (8)) b(pp) cross join (values (8), (16), (32), (64), (128)) c(dp) cross join (values (0), (1), (3)) z(zero) where tp * pp * dp = 512),
mem as (select *, 70e9 / (tp * pp) shard, 70e9 / (tp * pp) * (2 / case when zero >= 3 then dp else 1 end + 2 / case when zero >= 2 then dp else 1 end + 12.0e0 / case when zero >= 1 then dp else 1 end) static_bytes, IDIV(80, pp) * 8192e0 * 4096 * 5 * 2 / tp * least(pp, 4) act from g),
t as (select *, static_bytes + act total_bytes, 6 * 70e9 * 4e6 / (512 * 4e14) * (1 + (pp - 1) / 16e0) + case when tp > 1 then 4 * 80 * 8192e0 * 4096 * 2 * (tp - 1) / tp / 4e11 else 0 end + 2.0e0 * shard * 2 * (dp - 1) / dp / 5e10 step_s from mem)"""
both("per_gpu_memory", f"with {_GRID} select tp, pp, dp, zero, R6(static_bytes / pow(2, 30)) static_gb, R6(act / pow(2, 30)) act_gb, total_bytes < 80e9 fits from t")
both("step_time", f"with {_GRID} select tp, pp, dp, zero, R6(step_s) step_s, R6(6 * 70e9 * 4e6 / (512 * 9.89e14) / step_s) mfu from t")
both("parallel_search", f"with {_GRID}, r as (select tp, pp, dp, zero, R6(step_s) step_s, row_number() over (order by R6(step_s), tp * pp, zero, tp) rn from t where total_bytes < 80e9) select rn, tp, pp, dp, zero, step_s from r where rn <= 8".replace("select rn,", "select BIG(rn) rn,"))
_LINK = "l as (select * from (values ('nvlink', 450e0, 2e0, 1e0), ('ib', 40e0, 5e0, 1e0), ('eth', 10e0, 15e0, 1e0), ('eth_over', 40e0, 15e0, 4e0)) v(link, gbps, lat_us, over))"
add("link_time", lambda s, d: links(s, bytes=[1e6, 1e9]).select("link", "bytes", (F.col("gbps") / F.col("over")).alias("effective_gbps"), over_link(K.link_seconds, F.col("bytes")).alias("t")), f"with {_LINK} select link, bytes, gbps / over effective_gbps, R6(bytes / (gbps / over * 1e9) + lat_us / 1e6) t from l cross join (values (1e6), (1e9)) b(bytes)")
_RING = f"with {_LINK}, n as (select * from (values (8), (64), (1024)) v(ranks)), r as (select link, ranks, 2 * (ranks - 1) / DBL(ranks) * 140e9 / (gbps / over * 1e9) + 2 * (ranks - 1) * lat_us / 1e6 t from l cross join n) "
add("ring_allreduce", lambda s, d: links(s, ranks=[8, 64, 1024]).select("link", "ranks", over_link(K.ring_allreduce, 140e9, F.col("ranks")).alias("t")), _RING + "select link, ranks, R6(t) t from r")
both("hierarchical_allreduce", f"with {_LINK} select link, ranks, R6(2 * 7 / 8e0 * 140e9 / 450e9 + 2 * (ranks / 8e0 - 1) / (ranks / 8e0) * 140e9 / 8 / (gbps / over * 1e9) + 2 * (ranks / 8e0 - 1) * lat_us / 1e6) t from l cross join (values (64), (1024)) v(ranks)")
add("all_to_all", lambda s, d: links(s, ranks=[8, 64]).select("link", "ranks", over_link(K.all_to_all, 1e8, F.col("ranks")).alias("t")), f"with {_LINK} select link, ranks, R6((ranks - 1) / DBL(ranks) * 1e8 / (gbps / over * 1e9) + (ranks - 1) * lat_us / 1e6) t from l cross join (values (8), (64)) v(ranks)")
both("bucketed_allreduce", f"with {_LINK} select link, mb, least(400, BIG(ceil(140e9 / (mb * 1e6)))) buckets, R6(140e9 * 2 / (gbps / over * 1e9) + least(400, BIG(ceil(140e9 / (mb * 1e6)))) * lat_us / 1e6) t from l cross join (values (25), (100), (500)) v(mb)")
both("collectives_exposed", _RING + "select link, ranks, R6(greatest(0, t - 8)) exposed_s, R6((8 + greatest(0, t - 8)) / 8) slowdown from r")
both("straggler_impact", "select p, n, R6(1 - pow(1 - p, n)) any_slow, R6(1 + (1 - pow(1 - p, n)) * 0.5e0) step from (values (0.001e0), (0.0001e0)) v(p) cross join (values (64), (1024), (16384)) r(n)")

# Requests come from documents: prompt = least(n_chars div 4, 4000), output = 1 + doc_id * 7919 % 200.
R = "q as (select doc_id rid, least(IDIV(n_chars, 4), 4000) prompt, 1 + doc_id * 7919 % 200 outp from documents), r as (select *, row_number() over (order by rid) rn from q)"


def requests(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("rid"), F.expr("least(n_chars div 4, 4000)").alias("prompt"), (1 + F.col("doc_id") * 7919 % 200).alias("outp"))


def _static(spark, d):
    b = ranked(requests(spark, d), "rid", "rid", "rn").groupBy(F.expr("(rn - 1) div 32").alias("batch")).agg(F.max("outp").alias("longest"), F.sum("outp").alias("useful"))
    return b.agg(F.sum("longest").alias("iterations"), F.sum("useful").alias("useful")).withColumn("utilisation", F.col("useful") / (32 * F.col("iterations")))


add("static_batching", _static, f"with {R}, b as (select IDIV(rn - 1, 32) batch, max(outp) longest, sum(outp) useful, count(*) n from r group by IDIV(rn - 1, 32)) select BIG(sum(longest)) iterations, BIG(sum(useful)) useful, DBL(sum(useful)) / (32 * sum(longest)) utilisation from b")
both("naive_fragmentation", f"with {R} select BIG(sum(outp * prompt + IDIV(outp * (outp - 1), 2))) used, BIG(sum(outp * 4200)) reserved, 1 - DBL(sum(outp * prompt + IDIV(outp * (outp - 1), 2))) / sum(outp * 4200) wasted from r")
_SWEEP = f"with {R}, g as (select bs, prompt + t kv from r cross join (values (8), (16), (64)) v(bs) cross join (select EACH(SEQ(BIG(0), BIG(199))) t) s where t < outp) select bs, BIG(sum(bs * greatest(1, IDIV(kv + bs - 1, bs)))) reserved, BIG(sum(kv)) used, 1 - DBL(sum(kv)) / sum(bs * greatest(1, IDIV(kv + bs - 1, bs))) wasted, count(*) steps from g group by bs"
both("kv_block_sweep", _SWEEP)


def _order_statistics(spark, d):
    """The upper median and the 99th percentile, from counts by length: one row a length meets in the window."""
    by = requests(spark, d).groupBy("outp").agg(F.count("*").alias("c"))
    run = by.select("outp", F.sum("c").over(Window.orderBy("outp")).alias("upto"), F.sum("c").over(Window.partitionBy(F.lit(0))).alias("n"))
    at = lambda place: F.min(F.when(F.col("upto") >= place, F.col("outp")))
    return run.agg(at(F.expr("n div 2 + 1")).alias("median"), at(F.floor(0.99 * F.col("n")) + 1).alias("p99")).withColumn("ratio", F.col("p99") / F.col("median"))


add("output_length_statistics", _order_statistics, f"with {R}, o as (select outp, row_number() over (order by outp) k, count(*) over () n from r) select max(case when k = IDIV(n, 2) + 1 then outp end) median, max(case when k = BIG(floor(0.99e0 * n)) + 1 then outp end) p99, DBL(max(case when k = BIG(floor(0.99e0 * n)) + 1 then outp end)) / max(case when k = IDIV(n, 2) + 1 then outp end) ratio from o")
both("shared_prefix_cost", "select share, case when share then BIG(ceil(1200 / 16e0)) + 8 * BIG(ceil(200 / 16e0)) else 8 * BIG(ceil(1400 / 16e0)) end blocks from (values (true), (false)) v(share)")


SLOTS, BLOCK = 32, 16
_SCHEDULE = f"""with recursive {R}, p(rn, rid, prompt, outp, free, start) as (select 0::bigint, null::bigint, 0::bigint, 0::bigint, list_transform(range(0, 32), lambda x: 0::bigint), 0::bigint
union all select r.rn, r.rid, r.prompt, r.outp, list_transform(free, lambda f, i: case when i = list_position(free, list_min(free)) then f + r.outp else f end), list_min(free) from p join r on r.rn = p.rn + 1),
s as (select rid, prompt, start, start + outp stop from p where rn > 0)"""
add("continuous_batching", lambda s, d: V.utilisation(V.schedule(requests(s, d), "rid", "outp", SLOTS), SLOTS), _SCHEDULE + " select BIG(0) server, BIG(max(stop)) iterations, BIG(sum(stop - start)) useful, DBL(sum(stop - start)) / (max(stop) * 32) utilisation from s")
add("kv_peak_blocks", lambda s, d: V.peak_blocks(V.schedule(requests(s, d), "rid", "outp", SLOTS), requests(s, d), "rid", "prompt", BLOCK), _SCHEDULE + ", g as (select t, sum(greatest(1, (prompt + t - start + 15) // 16)) blocks from (select prompt, start, unnest(range(start, stop)) t from s) x group by t) select BIG(0) server, BIG(max(blocks)) peak_blocks from g")


def _refcounts(spark, d):
    """Cache blocks by the first 16 tokens of a prompt (here the first word): requests of one prefix hold it while they run."""
    q = requests(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("rid"), F.coalesce(F.regexp_extract(F.lower("text"), "[a-z]+", 0), F.lit("")).alias("blk")), "rid")
    return V.share_counts(V.schedule(requests(spark, d), "rid", "outp", SLOTS).join(q.select("rid", "blk"), "rid"), "blk", "start", "stop").select("blk", F.col("peak").cast("long").alias("peak"), F.col("left").cast("long").alias("left_over"))


add("block_refcounts", _refcounts, _SCHEDULE + ", b as (select s.start, s.stop, regexp_extract(lower(coalesce(text, '')), '[a-z]+') blk from s join documents on rid = doc_id), e as (select blk, start t, 1 d from b union all select blk, stop, -1 from b), c as (select blk, t, sum(d) d from e group by 1, 2), w as (select blk, t, sum(d) over (partition by blk order by t) refs from c) select blk, BIG(max(refs)) peak, BIG(arg_max(refs, t)) left_over from w group by blk")
both("decode_floor", "select model, gb, bw, R6(gb / bw * 1000) ms, R6(flops / (bw * 1e9) ) roofline_batch from (values ('8b', 16e0, 3350e0, 9.89e14), ('70b', 140e0, 3350e0, 9.89e14)) v(model, gb, bw, flops)")
add("ckpt_interval", lambda s, d: given(s, [(60.0, 12.0), (10.0, 3.0), (2.0, 3.0)], "c double, mtbf_h double").select("c", "mtbf_h", F.round(K.checkpoint_interval(F.col("c"), F.col("mtbf_h")), 6).alias("interval_s"), F.round(K.checkpoint_overhead(F.col("c"), F.col("mtbf_h")), 6).alias("overhead")), "select c, mtbf_h, R6(sqrt(2 * c * mtbf_h * 3600)) interval_s, R6(c / sqrt(2 * c * mtbf_h * 3600) + sqrt(2 * c * mtbf_h * 3600) / (2 * mtbf_h * 3600)) overhead from (values (60e0, 12e0), (10e0, 3e0), (2e0, 3e0)) v(c, mtbf_h)")
both("cluster_mtbf", "select gpus, R6(50000e0 / gpus) mtbf_h, R6(54 * 24 / (50000e0 / gpus)) interruptions from (values (1024), (16384), (100000)) v(gpus)")
both("compute_bill", "select params, tokens, R6(6 * params * tokens / (9.89e14 * 0.4e0) / 3600) gpu_hours, R6(6 * params * tokens / (9.89e14 * 0.4e0) / 3600 * 2) dollars from (values (8e9, 15e12), (70e9, 15e12)) v(params, tokens)")


def runs(spark):
    return spark.createDataFrame([(1e5, 4.2), (3e5, 3.8), (1e6, 3.45), (3e6, 3.2), (1e7, 3.0), (3e7, 2.86), (1e8, 2.76)], "n double, loss double")


_RUNS = "runs as (select * from (values (1, 1e5, 4.2e0), (2, 3e5, 3.8e0), (3, 1e6, 3.45e0), (4, 3e6, 3.2e0), (5, 1e7, 3.0e0), (6, 3e7, 2.86e0), (7, 1e8, 2.76e0)) v(k, n, loss))"
both("ols_fit", f"with {_RUNS} select R6(regr_slope(LN(loss), LN(n))) slope, R6(regr_intercept(LN(loss), LN(n))) intercept from runs")
_FIT = f"with {_RUNS}, e as (select EACH(SEQ(0, 2999)) i), x as (select i, i * 2.7e0 / 3000 ee, LN(n) lx, LN(loss - i * 2.7e0 / 3000) ly, n, loss from runs cross join e), f as (select i, max(ee) ee, regr_slope(ly, lx) b, regr_intercept(ly, lx) a from x group by i), s as (select f.i, f.ee, f.a, f.b, sum(pow(f.ee + exp(f.a + f.b * LN(n)) - loss, 2)) sse from f cross join runs group by f.i, f.ee, f.a, f.b), r as (select *, row_number() over (order by round(sse, 12), i) rn from s) "
add("scaling_fit", lambda s, d: K.fit_scaling(runs(s), "n", "loss").select("i", F.round("e", 6).alias("e"), F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept")), _FIT + "select BIG(i) i, R6(ee) e, R6(b) slope, R6(a) intercept from r where rn = 1")
both("scaling_predict", _FIT + "select n, R6(ee + exp(a + b * LN(n))) predicted from r cross join (values (1e9), (1e10)) v(n) where rn = 1")
_REFIT = _FIT.split("r as (select")[0].replace("x as (select i,", "m as (select * from (values (4), (5), (6), (7)) v(m)), x as (select m, i,").replace("from runs cross join e)", "from runs cross join e cross join m where k <= m)").replace("f as (select i, max(ee)", "f as (select m, i, max(ee)").replace("from x group by i)", "from x group by m, i)").replace("s as (select f.i,", "s as (select f.m, f.i,").replace("from f cross join runs group by f.i,", "from f join runs on runs.k <= f.m group by f.m, f.i,")
both("scaling_refits", _REFIT + "r as (select *, row_number() over (partition by m order by round(sse, 12), i) rn from s) select m, BIG(i) i, R6(ee + exp(a + b * LN(n))) predicted, R6((ee + exp(a + b * LN(n)) - loss) / loss) held_out_error from r cross join runs where rn = 1 and k = 7")
both("entropy_head", "with z as (select r, 1.0e0 / r w from (select EACH(SEQ(1, 1000)) r) x), p as (select r, w / sum(w) over () p from z) select R6(-sum(p * LN(p))) entropy, R6(sum(case when r <= 10 then p else 0 end)) head10 from p")
both("zipf_source", "with z as (select r, 1.0e0 / pow(r, 1.1e0) w from (select EACH(SEQ(1, 256)) r) x) select BIG(r) r, R9(w / sum(w) over ()) p from z")
both("rope_wavelengths", "select BIG(i) i, R6(pow(base, -2 * i / 128e0)) inv_freq, R6(2 * pi() * pow(base, 2 * i / 128e0)) wavelength, 2 * pi() * pow(base, 2 * i / 128e0) <= 8192 full_turn, base from (select EACH(SEQ(0, 63)) i) x cross join (values (10000e0), (500000e0)) b(base)")
both("rope_scaling", "select BIG(i) i, R9(pow(1e4, -2 * i / 128e0)) none, R9(pow(1e4, -2 * i / 128e0) / 4) pi_scaled, R9(pow(1e4 * pow(4, 128 / 126e0), -2 * i / 128e0)) ntk, R9(pow(1e4, -2 * i / 128e0) * (g + (1 - g) / 4)) yarn, R6(2 * pi() / (pow(1e4, -2 * i / 128e0) * (g + (1 - g) / 4))) yarn_wavelength from (select i, least(1.0e0, greatest(0.0e0, (4096 * pow(1e4, -2 * i / 128e0) / (2 * pi()) - 1) / 31)) g from (select EACH(SEQ(0, 63)) i) x) y")
both("binned_loss", "select IDIV(n_chars, 2000) bin, count(*) n, R6(avg(LN(1e0 + n_chars))) loss from documents group by IDIV(n_chars, 2000)")
_X = {"spark": "(select vec_id, BIG(pos) e, cast(col as double) logit from (select vec_id, posexplode(embedding) from embeddings))", "duck": "(select vec_id, BIG(unnest(range(0, 64))) e, unnest(embedding)::double logit from embeddings)"}
_TOP = "with x as {t}, s as (select vec_id, e, exp(logit) / sum(exp(logit)) over (partition by vec_id) p, row_number() over (partition by vec_id order by logit desc, e) rk from x), k as (select e, sum(case when rk <= 2 then 1 else 0 end) load, avg(p) mean_p, count(*) n from s group by e) "
for _name, _sel in (
    ("router_topk_load", "select e, BIG(load) load, R6(mean_p) mean_p from k"),
    ("router_aux_loss", "select R6(64 * sum(load / (2.0e0 * n) * mean_p)) aux from k"),
    ("router_bias_update", "select e, R6(0.001e0 * (0.015625e0 - load / (2.0e0 * n)) * 64) bias from k"),
    ("router_gini", ", r as (select load, row_number() over (order by load, e) i, count(*) over () m, sum(load) over () total, max(load) over () hi from k) select R6(2 * sum(i * load) / (max(m) * DBL(max(total))) - (max(m) + 1) / DBL(max(m))) gini, R6(max(hi) * max(m) / DBL(max(total))) max_over_mean, COUNT_IF(load = 0) dead from r"),
):
    both(_name, (_TOP + _sel).format(t=_X["duck"]).replace(") , r as", "), r as"), (_TOP + _sel).format(t=_X["spark"]).replace(") , r as", "), r as"))
_GATES = "with x as {t}, s as (select vec_id, e, exp(logit) w, row_number() over (partition by vec_id order by logit desc, e) rk from x), k as (select vec_id, e, w, rk from s where rk <= 2) select vec_id, e, R6(w / sum(w) over (partition by vec_id)) gate from k"
both("router_gates", _GATES.format(t=_X["duck"]), _GATES.format(t=_X["spark"]))
_B = {"spark": "(select vec_id, pos, abs(cast(col as double)) v from (select vec_id, posexplode(embedding) from embeddings))", "duck": "(select vec_id, unnest(range(0, 64)) pos, abs(unnest(embedding)::double) v from embeddings)"}
_FP8 = "with x as {t}, b as (select vec_id, IDIV(pos, 16) blk, max(v) m, count(*) n from x group by vec_id, IDIV(pos, 16)) select BIG(blk) blk, R6(min(m) / 448) lo_scale, R6(max(m) / 448) hi_scale, count(*) n from b group by blk"
both("fp8_block_scales", _FP8.format(t=_B["duck"]), _FP8.format(t=_B["spark"]))
# values below half the least subnormal of e4m3 (2^-10) after scaling to 448 become zero
_ZERO = "with x as {t}, b as (select vec_id, pos, v, max(v) over (partition by vec_id, IDIV(pos, 16)) bm, max(v) over (partition by vec_id) tm from x where true), c as (select vec_id, count(*) n, COUNT_IF(v > 0 and v * 448 < tm / 1024) by_tensor, COUNT_IF(v > 0 and v * 448 < bm / 1024) by_block, max(tm) / 448 tensor_scale from b group by vec_id) select vec_id, R9(tensor_scale) tensor_scale, DBL(by_tensor) / n zeroed_by_tensor, DBL(by_block) / n zeroed_by_block from c"
both("fp8_zeroed_share", _ZERO.format(t=_B["duck"]), _ZERO.format(t=_B["spark"]))
both("fusion_traffic", "select BIG(tok) * hid * 2 * 7 unfused, BIG(tok) * hid * 2 * 2 fused, 7 / 2e0 ratio, R6(5e0 * tok * hid / (BIG(tok) * hid * 2 * 7)) intensity_unfused, R6(5e0 * tok * hid / (BIG(tok) * hid * 2 * 2)) intensity_fused from (values (4096, 4096)) v(tok, hid)")
both("reshard", "select IDIV(doc_id * 8, n) old_shard, IDIV(doc_id * 4, n) new_shard, count(*) n_rows from documents cross join (select max(doc_id) + 1 n from documents) m group by IDIV(doc_id * 8, n), IDIV(doc_id * 4, n)")
both("speculative_prefix", "with p as (select user_id, IDIV(rn - 1, 4) blk, (rn - 1) % 4 pos, value > 20 ok from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) rn from events) e) select user_id, BIG(blk) blk, BIG(coalesce(min(case when not ok then pos end), count(*))) accepted from p group by user_id, blk")
both("zero_gradient_share", "select g, R6(sum(w * (pow(p, g) + pow(1 - p, g)))) share from (values (0.2e0, 0.05e0), (0.3e0, 0.3e0), (0.3e0, 0.7e0), (0.2e0, 0.95e0)) v(w, p) cross join (values (4), (8), (16)) s(g) group by g")
both("pass_tables", "select p, k, R6(1 - pow(1 - p, k)) pass_at, R6(pow(p, k)) pass_hat from (values (0.3e0), (0.4e0), (0.6e0), (0.9e0)) v(p) cross join (values (1), (2), (4), (8), (16)) s(k)")
both("goodput", "with c as (select * from (values ('a', 180e0, 40e0, 900e0), ('b', 420e0, 35e0, 1400e0), ('c', 900e0, 55e0, 2100e0), ('d', 250e0, 48e0, 1100e0)) v(cfg, ttft, tpot, tput)), r as (select cfg, tput, row_number() over (order by tput desc, cfg) rn from c where ttft <= 500 and tpot <= 50) select cfg, tput from r where rn = 1")
both("rejection_sampling", "select k, R6(1 - pow(1 - 0.15e0, k)) coverage, BIG(100000) * k * 800 tokens, R6(100000e0 * k * 800 / 2500 / 3600) gpu_hours from (values (1), (4), (16), (64)) v(k)")
add("pipeline_bubble", lambda s, d: given(s, [(4,), (8,), (16,)], "p int", m=[8, 32, 128]).select("p", "m", K.pipeline_bubble(F.col("p"), F.col("m")).alias("bubble")), "select p, m, (p - 1) / DBL(m + p - 1) bubble from (values (4), (8), (16)) v(p) cross join (values (8), (32), (128)) s(m)")
both("lr_schedule", "select BIG(step) step, R9(case when step < 100 then 3e-4 * step / 100 else 3e-5 + 0.5e0 * (3e-4 - 3e-5) * (1 + cos(pi() * (step - 100) / 900)) end) lr from (select EACH(SEQ(0, 1000)) step) s")
both("checkpoint_size", "select part, params * bytes size from (values ('weights', 2), ('master', 4), ('momentum', 4), ('variance', 4)) v(part, bytes) cross join (values (70e9)) p(params)")
both("rloo_golden", "with v as (select * from (values (1, 2.1e0), (2, 2.8e0), (3, 1.6e0), (4, 2.4e0), (5, 2.9e0), (6, 1.9e0), (7, 2.5e0), (8, 2.0e0)) x(i, r)) select BIG(i) i, R6(r - (sum(r) over () - r) / 7) rloo, R6((r - avg(r) over ()) / (stddev_samp(r) over () + 0.0001e0)) grpo from v")
both("safety_tradeoff", "select name, R6((b0 - b1) / b0) harm_drop, R6(o1 / o0 - 1) refusal_rise, R6((1 - b1) * (1 - o1)) combined from (values ('a', 0.12e0, 0.03e0, 0.05e0, 0.09e0), ('b', 0.12e0, 0.05e0, 0.05e0, 0.06e0)) v(name, b0, b1, o0, o1)")
both("chinchilla_split", "select c, R6(LN(sqrt(c / 120)) / LN(10)) log10_params, R6(LN(20 * sqrt(c / 120)) / LN(10)) log10_tokens from (values (1e21), (1e23), (1e25)) v(c)")
both("mup_scaling", "select width, 3e-3 * 256 / width lr, R6(1 / sqrt(width)) init from (values (256), (1024), (4096)) v(width)")
both("long_context_cost", "select ctx, R6(12e0 * 8192 * ctx / (6e0 * 8192 * 8192 * 12)) attention_share, R6(ctx / 8192e0) kv_growth from (values (8192), (32768), (131072), (1048576)) v(ctx)")
both("midtraining_budget", "select frac, 15e12 * frac tokens, 6 * 70e9 * 15e12 * frac flops from (values (0.01e0), (0.02e0), (0.05e0)) v(frac)")
both("reasoning_cost", "select n, tokens, R6(n * tokens * 2 * 70e9 / 1e12) tflops, R6(1 - pow(1 - 0.4e0, n)) acc from (values (1, 500), (4, 500), (16, 500), (1, 8000)) v(n, tokens)")
both("train_plus_inference", "select q, 6 * 70e9 * 15e12 train, 2 * 70e9 * 1000 * q inference, 2 * 70e9 * 1000 * q > 6 * 70e9 * 15e12 inference_dominates from (values (1e9), (1e11), (1e13)) v(q)")
