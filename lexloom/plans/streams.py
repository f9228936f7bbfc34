"""Event windows, streaming twins, and a small relational layer over the star schema (E rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators.contamination import grams
from lexloom.plans.contamination import ORACLES as BATCH
from lexloom.plans.dialect import Plans
from lexloom.plans.samples import training_log
from lexloom.sources.tables import table
from lexloom.streaming import health, live

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add

_TUMBLE = "select time_bucket(interval '1 hour', ts) start, event_type, count(*) n from events group by 1, 2"
both("events_tumbling", _TUMBLE, "select w.start start, event_type, n from (select window(ts, '1 hour') w, event_type, count(*) n from events group by window(ts, '1 hour'), event_type) x")
both("events_sliding", "select s start, count(*) n from (select unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) s from events) x group by s", "select w.start start, n from (select window(ts, '1 hour', '30 minutes') w, count(*) n from events group by window(ts, '1 hour', '30 minutes')) x")
both(
    "events_session",
    "with l as (select user_id, ts, ts - lag(ts) over (partition by user_id order by ts) gap from events), s as (select user_id, ts, sum(case when gap is null or gap >= interval '6 hours' then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) k from l) select user_id, min(ts) start, count(*) n from s group by user_id, k",
    "select user_id, w.start start, n from (select user_id, session_window(ts, '6 hours') w, count(*) n from events group by user_id, session_window(ts, '6 hours')) x",
)
# the twins: complete mode has every window, as no later event can close the last ones
add("events_tumbling_stream", lambda s, d: live.finished(live.tumbling(live.source(s, d, "events")), "complete"), _TUMBLE)
add("exact_dedup_stream", lambda s, d: live.finished(live.first_texts(live.source(s, d, "documents"))), "select distinct sha256(text) h from documents")


def _bench(spark, d, n=13):
    return grams(table(spark, d, "benchmark"), "item_id", n).select("g").distinct()


add("contamination_stream", lambda s, d: live.finished(live.contaminated(live.source(s, d, "documents"), _bench(s, d))), BATCH["contam_docs_13"].replace("select doc_id, count(*) n_grams from", "select doc_id from"))
add("clean_documents_stream", lambda s, d: live.finished(live.without_contaminated(live.source(s, d, "documents"), _bench(s, d), 13).select("doc_id")), BATCH["contam_docs_13"].replace("select doc_id, count(*) n_grams from dg where g in (select g from bg) group by 1", "select doc_id from documents where doc_id not in (select doc_id from dg where g in (select g from bg))"))


def _late(spark, d):
    """Events older than the newest one seen before them in arrival (id) order: maxima of ranges of ids first, then running maxima inside each range."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select("event_id", "ts", F.expr("event_id div 10000").alias("part"))
    top = e.groupBy("part").agg(F.max("ts").alias("top"))
    before = top.select("part", F.max("top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))  # one row a range
    inside = F.max("ts").over(Window.partitionBy("part").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    seen = e.withColumn("inside", inside).join(before, "part").withColumn("seen", F.greatest("inside", "earlier"))
    return seen.agg(F.count_if(F.expr("ts < seen")).alias("late"), F.count("*").alias("n"))


add("late_events", _late, "with m as (select event_id, ts, max(ts) over (order by event_id rows between unbounded preceding and 1 preceding) seen from events) select COUNT_IF(ts < seen) late, count(*) n from m")
both("health_alerts", "with l as (select user_id, event_id, value, avg(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding) base from events) select user_id, count(*) alerts from l where value > 20 * base group by user_id")
add(
    "health_alerts_stream", lambda s, d: live.finished(live.health_alerts(live.source(s, d, "events")), "complete"),
    "select time_bucket(interval '1 day', ts) start, count(*) n, max(value) > 10 * avg(value) spike, bool_or(value is null or isnan(value) or isinf(value)) non_finite, count(distinct event_type) < 5 missing_kind from events group by 1",
)


# E-02, E-05: every fifth event is delivered twice, every thirteenth late by half the table; what is left, and what came behind the watermark (that of the micro-batch before, by which Spark drops)
def _deliveries(spark, d):
    e = table(spark, d, "events").select("event_id", "ts", "event_type")
    i, half = F.col("event_id"), (e.agg(F.max("event_id").alias("m")).first().m or 0) // 2
    late = F.when(i % 13 == 0, half).otherwise(0)
    again = F.when(i % 5 == 0, F.array(late, late + F.when(i % 50 == 0, half).otherwise(3))).otherwise(F.array(late))
    return e.select("*", F.explode(again).alias("by")).select("event_id", "ts", "event_type", (i + F.col("by")).alias("place"))


def _late_deliveries(spark, d):
    progress = []
    kept = live.finished(live.first_events(live.arriving(_deliveries(spark, d), "place", 6), delay="6 hours"), progress=progress)
    late = spark.range(1).select(F.lit("late").alias("kind"), F.lit(live.dropped_late(progress)).cast("long").alias("n"), F.lit(0).cast("long").alias("n_events"))
    return kept.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_events")).union(late)


add(
    "late_deliveries", _late_deliveries,
    "with h as (select max(event_id) // 2 half from events), a as (select event_id, ts, event_type, event_id + case when event_id % 13 = 0 then half else 0 end place from events, h union all select event_id, ts, event_type, event_id + case when event_id % 13 = 0 then half else 0 end + case when event_id % 50 = 0 then half else 3 end from events, h where event_id % 5 = 0), "
    "p as (select *, place * 6 // (select max(place) + 1 from a) part from a), t as (select part, max(date_trunc('milliseconds', ts)) - interval '6 hours' top from p group by 1), w as (select part, max(top) over (order by part rows between unbounded preceding and 2 preceding) mark from t), "
    "l as (select p.*, coalesce(ts <= mark, false) late from p join w using (part)) select event_type kind, count(distinct event_id) n, count(distinct event_id) n_events from l where not late group by 1 union all select 'late', count(*), 0 from l where late",
)

# E-04: the checks of runs of 1000 events, four ranks a step and an event a second, as a stateful stream that ends a minute before the last event
#: A whole minute, as the watermark begins at the epoch.
STARTED = 60 * 28_333_333


def _run_log(spark, d):
    return training_log(spark, d, "event_id").withColumns({"run": F.expr("event_id div 1000"), "ts": F.timestamp_seconds(F.col("event_id") + STARTED)})


def _health_stream(spark, d):
    (name, store), = live.ROCKSDB.items()
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        return live.finished(health.health_checks(live.arriving(_run_log(spark, d), "event_id").drop("event_id")))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


add(
    "health_checks_stream", _health_stream,
    "with l as (select IDIV(event_id, 1000) run, event_id, IDIV(event_id, 4) step, case when event_id % 997 = 0 then 'nan'::double else value end loss, JSONK(props) / 8.0e0 grad, case when event_id % 211 = 0 then 9.0e0 else 1.0e0 end + JSONK(props) / 1000.0e0 secs, IDIV(IDIV(event_id, 4), 1500) * 1500 saved, case when event_id % 503 = 3 then 1 else 0 end + IDIV(event_id, 4) * 7 h from events), "
    "c as (select max(event_id) - 60 now from events), "
    "p as (select run, step, max(event_id) at_s, count(*) filter (where isnan(loss) or grad is null) bad, max(loss) filter (where not isnan(loss)) loss, max(grad) grad, max(secs) secs, max(saved) saved, count(distinct h) hs from l group by run, step), "
    "w as (select *, lag(loss) over (partition by run order by step) prev, median(secs) over (partition by run order by step rows between 100 preceding and 1 preceding) usual from p) "
    "select run, step, bad > 0 non_finite, coalesce(loss > 2 * prev, false) spike, coalesce(grad > 10, false) explosion, coalesce(grad = 0, false) collapse, coalesce(secs > 1.5 * usual, false) slow, coalesce(step - saved > 1000, true) stale, hs > 1 diverged, false silent from w, c where (IDIV(at_s, 60) + 1) * 60 <= now "
    "union all select run, max(step), false, false, false, false, false, false, false, true from p, c group by run, now having max(at_s) + 600 <= now",
)

both("pricing_summary", "select l_returnflag, l_linestatus, count(*) n, BIG(sum(l_quantity)) qty, R6(sum(cast(l_extendedprice as decimal(18, 2)))) price from lineitem group by l_returnflag, l_linestatus")
both("revenue_by_nation", "select n_name, R6(sum(cast(l_extendedprice as decimal(18, 2)))) revenue from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by n_name")
both("orders_rollup", "select year_, month_, count(*) n from (select BIG(year(o_orderdate)) year_, BIG(month(o_orderdate)) month_ from orders) o group by rollup (year_, month_)")
both("top_customers", "select c_custkey, n from (select c_custkey, count(*) n from customer join orders on c_custkey = o_custkey group by c_custkey) x order by n desc, c_custkey limit 10")
both("suppliers_without_region", "select s_suppkey from supplier left join nation on s_nationkey = n_nationkey left join region on n_regionkey = r_regionkey where r_regionkey is null")
both("set_operations", "select k from (select n_nationkey k from nation intersect select s_nationkey k from supplier) a union all select k from (select n_nationkey k from nation except select s_nationkey k from supplier) b")
