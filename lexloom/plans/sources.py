"""Sources and sinks other than the tables (G rows)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexloom.operators.shared import shared_dir
from lexloom.plans.dialect import Plans
from lexloom.sources.tables import table
from lexloom.sources.warc import read_warc, write_warc

P = Plans()
QUERIES, ORACLES = P.queries, P.oracles
both, add = P.both, P.add

#: So small that files of the test tables are read by several tasks.
SPLIT_BYTES = 64 << 10


def crawl(spark, d):
    """The pages as archives in the shared folder: a record for each, and one of metadata for each hundredth."""
    pages = table(spark, d, "pages").select("page_id", F.col("url").alias("uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("block"))
    meta = pages.where("page_id % 100 = 0").select(F.lit("metadata").alias("type"), "uri", F.encode(F.concat(F.lit("page: "), F.col("page_id").cast("string")), "UTF-8").alias("block"))
    path = f"{shared_dir(spark)}/lexloom-warc-{uuid.uuid4().hex}"
    write_warc(pages.select(F.lit("response").alias("type"), "uri", "block").union(meta), path)
    return path


add(
    "warc_pages",
    lambda s, d: read_warc(s, crawl(s, d), "type string, uri string, length long, digest string, block binary", SPLIT_BYTES).where("type = 'response'").select("uri", "length", F.md5("block").alias("payload_md5"), F.length("digest").cast("long").alias("n_digest")),
    "select url uri, strlen(coalesce(html, ''))::bigint length, md5(coalesce(html, '')) payload_md5, 37::bigint n_digest from pages",
)
add(
    "warc_types",
    lambda s, d: read_warc(s, crawl(s, d), "type string, length long", SPLIT_BYTES).groupBy("type").agg(F.count("*").alias("n"), F.sum("length").alias("n_bytes")),
    "select type, count(*) n, sum(strlen(x))::bigint n_bytes from (select 'response' as type, coalesce(html, '') x from pages union all select 'metadata', 'page: ' || page_id from pages where page_id % 100 = 0) group by 1",
)
# a title and the links of archived pages, as the queries on the table find them
add(
    "warc_titles",
    lambda s, d: read_warc(s, crawl(s, d), "type string, uri string, block binary", SPLIT_BYTES).where("type = 'response'").select("uri", F.decode("block", "UTF-8").alias("html")).select("uri", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit('href="([^"]*)"')).cast("long").alias("n_links")),
    "select url uri, regexp_extract(html, '<title>([^<]*)</title>', 1) title, len(regexp_extract_all(html, 'href=\"([^\"]*)\"'))::bigint n_links from pages",
)
