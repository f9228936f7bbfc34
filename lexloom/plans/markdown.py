"""Documentation-tooling queries (R rows), over pages: a page's path is its file, its links and headings are the HTML's."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.operators.shared import shared_dir
from lexloom.plans.dialect import Plans
from lexloom.sources.files import read_json
from lexloom.sources.stages import Stages, write_shards
from lexloom.sources.tables import table

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add

_F = """f as (select page_id, REPLACE_ALL(REPLACE_ALL(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '') path, url, html from pages),
k as (select page_id, link from (select page_id, EACH(regexp_extract_all(html, 'href="([^"]*)"', 1)) link from f) t),
h as (select page_id, heading from (select page_id, EACH(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) heading from f) t)"""
both("broken_links", f"with {_F} select distinct k.page_id, link from k left join f on f.path = k.link where f.path is null and link like '/%'")
both("duplicate_anchors", f"with {_F}, s as (select page_id, replace(trim(REPLACE_ALL(lower(heading), '[^a-z0-9 -]', '')), ' ', '-') slug from h), r as (select slug, page_id, row_number() over (partition by slug order by page_id) - 1 k from s) select page_id, slug, case when k = 0 then slug else concat(slug, '-', cast(k as varchar(20))) end anchor from r")
add("missing_stamps", lambda s, d: table(s, d, "pages").where(~F.coalesce(F.exists(F.slice(F.split("html", "\n"), 1, 15), lambda x: x.rlike("charset=.utf-8")), F.lit(False))).select("page_id"), "select page_id from pages where len(list_filter(string_split(html, chr(10))[1:15], lambda x: regexp_matches(x, 'charset=.utf-8'))) = 0")
both("required_fields", f"with {_F} select page_id, field from f cross join (values ('<title>'), ('<nav>'), ('<article>'), ('<footer>')) v(field) where not contains(html, field)")
both("uncited_rows", f"with {_F}, c as (select page_id, EACH(regexp_extract_all(html, '<p>([^<]*)', 1)) row_ from f) select page_id, COUNT_IF(not MATCHES(row_, '[0-9]')) uncited, count(*) n from c group by page_id")
both("orphan_pages", f"with {_F}, q as (select distinct link from k) select page_id from f left join q on q.link = f.path where q.link is null")
both("chapter_companions", "select d.doc_id, l.doc_id is null no_label, e.vec_id is null no_vector from documents d left join labels l on d.doc_id = l.doc_id left join embeddings e on d.doc_id = e.vec_id")


def _transcription(spark, d):
    """The documents written as JSON lines, read again and compared with the table: rows of one side alone, or that differ."""
    docs = table(spark, d, "documents")
    path = f"{shared_dir(spark)}/transcript-{uuid.uuid4().hex}"
    docs.write.json(path)
    copy = read_json(spark, path, docs.schema)
    return docs.exceptAll(copy).agg(F.count("*").alias("lost")).crossJoin(copy.exceptAll(docs).agg(F.count("*").alias("added"))).crossJoin(copy.agg(F.count("*").alias("n")))


add("transcription_differences", _transcription, "select BIG(0) lost, BIG(0) added, count(*) n from documents")


def _stage(spark, d):
    """One stage written twice under one version: the second run finds it complete, with the statistics of the first."""
    stages, docs = Stages(spark, f"{shared_dir(spark)}/stages-{uuid.uuid4().hex}"), table(spark, d, "documents")
    for _ in range(2):
        stages.write("documents", "1", docs, n_chars=F.sum("n_chars"), empty=F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0))
    return stages.statistics("documents", "1").select("name", F.col("value").cast("long").alias("value"))


add("stage_statistics", _stage, "select unnest(['n_rows', 'n_chars', 'empty']) name, unnest([count(*), sum(n_chars), count(*) filter (where coalesce(length(text), 0) = 0)])::bigint as \"value\" from documents")


def _shards(spark, d):
    out = write_shards(table(spark, d, "documents"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", "doc_id", 16)
    out = out.select(F.col("shard").cast("long").alias("shard"), "n_chars", F.input_file_name().alias("file"))
    return out.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.countDistinct("file").alias("files"))


add("shard_files", _shards, "select H32(cast(doc_id as varchar)) % 16 shard, count(*) n, BIG(sum(n_chars)) chars, BIG(1) files from documents group by 1")
both("stale_artifacts", "select doc_id, n_chars, BIG(length(text)) now_chars from documents where n_chars <> length(text)")
