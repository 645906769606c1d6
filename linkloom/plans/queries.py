"""Queries that apply the operators to the given tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cron import cron_rejects, firings
from ..functions.filters import compile_filters
from ..functions.text import brief_summary
from ..functions.urls import file_name, host
from ..operators import config as cfg
from ..operators import exchange as ex
from ..operators import frontier as fr
from ..operators import links as lk
from ..operators import metrics, parts, responses, schedule
from ..operators.html import page_nodes, shred_html
from ..sources.batches import BatchTable, StateTable
from ..sources.csvmaps import read_csv_maps, write_csv_maps
from ..sources.files import publish_batch
from ..sources.snapshots import BucketedTable
from ..sources.staged import scratch
from ..operators.selectors import Selector
from ..sources import documents as dt
from ..schemas import PAGE_TAG
from .derived import BUILT, CONFIG, EVENTS, HOST, MESSAGES, SKIP, URIS, built_pages, crawl_events, messages, page_uris, site_config, table

AS_OF = datetime(2024, 1, 15, 12, 0, 0)

#: Tags that the parts of pages of orders are found by: their tables, or all of them. Other nodes are read but not kept.
TABLE_TAGS = (PAGE_TAG, "table", "tr", "td", "th")
ORDER_TAGS = (*TABLE_TAGS, "title", "body", "h1", "a", "img")


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


ALL: dict[str, Query] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        ALL[f.__name__] = Query(f, sql)
        return f

    return add


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


LINKS = r"""hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS ord FROM pages),
found AS (SELECT page_id, ord, href, url AS base_uri, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || list_aggregate(list_transform(regexp_extract_all(href, '[\x00-\x7F]+|[^\x00-\x7F]+'), lambda x: CASE WHEN regexp_matches(x, '^[\x00-\x7F]') THEN x ELSE url_encode(x) END), 'string_agg', '') AS uri FROM hrefs)"""
DOMAIN = f"""{HOST.format("replace(lower({0}), 'www.', '')")}"""


@query(f"""WITH {LINKS}, seen AS (SELECT DISTINCT lower(url) AS u FROM pages WHERE url IS NOT NULL)
SELECT {HOST.format('uri')} AS host, count(*) AS n_links FROM (SELECT DISTINCT uri FROM found WHERE {DOMAIN.format('uri')} = {DOMAIN.format('base_uri')}) x
WHERE lower(uri) NOT IN (SELECT u FROM seen) GROUP BY 1""")
def new_links_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that stay in their domain and that no page has yet, counted by host."""
    pages = table(spark, sf_dir, "pages")
    links = lk.within_domain(parts.page_links(shred_html(pages, tags=["a"]), pages)).select("uri").distinct()
    seen = pages.select(F.lower("url").alias("key")).distinct()
    new = links.withColumn("key", F.lower("uri")).join(seen, "key", "left_anti")
    return new.groupBy(host("uri").alias("host")).agg(F.count("*").alias("n_links"))


@query(f"WITH {LINKS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INTEGER) AS ord, uri, text, base_uri FROM (SELECT page_id, base_uri, uri, substr(href, 2) AS text, min(ord) AS o FROM found GROUP BY ALL) x")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return parts.extract_links(page_nodes(pages), pages)


@query(f"WITH {LINKS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INTEGER) AS ord, uri, text FROM (SELECT page_id, uri, substr(href, 2) AS text, min(ord) AS o FROM found GROUP BY ALL) x")
def extract_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return parts.extract_files(page_nodes(pages), pages).select("page_id", "ord", "uri", "text")


@query(r"SELECT page_id, 'meta' AS slot, repeat(chr(10), len(regexp_extract_all(html, '<meta '))) AS text FROM pages WHERE regexp_matches(html, '<meta ')")
def extract_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.extract_meta(page_nodes(table(spark, sf_dir, "pages")))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\s*\n\s*', ' ', 'g')) || chr(10) AS title FROM pages WHERE regexp_matches(html, '<title>')""")
def article_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.extract_text(page_nodes(table(spark, sf_dir, "pages")), parts.TITLE).select("page_id", F.col("text").alias("title"))


@query("SELECT 'MissingText' AS anomaly_type, count(*) AS n FROM pages WHERE NOT regexp_matches(html, '<table') OR html IS NULL HAVING count(*) > 0")
def anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return parts.anomaly_counts(parts.anomalies(page_nodes(pages), pages, [Selector("t", "//table")]))


@query(f"""WITH {BUILT}, found AS (SELECT 'MissingTitle' AS t FROM (SELECT DISTINCT page_id FROM ord) x WHERE page_id % 6 = 0 UNION ALL SELECT 'MissingText' FROM (SELECT DISTINCT page_id FROM ord) x
UNION ALL SELECT 'MissingFileLink' FROM ord GROUP BY page_id HAVING bool_and(bare) UNION ALL SELECT 'MissingImg' FROM full_ord WHERE k % 3 = 1 UNION ALL SELECT 'MissingHeader' FROM inner_tables UNION ALL SELECT 'MissingRow' FROM ord WHERE bare
UNION ALL SELECT 'MissingTable' FROM (SELECT DISTINCT page_id FROM ord) x, range(4)) SELECT t AS anomaly_type, count(*) AS n FROM found GROUP BY 1""")
def built_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven kinds of anomaly on pages of orders; headers among what should be tables are missing tables."""
    pages = built_pages(spark, sf_dir)
    return parts.anomaly_counts(parts.anomalies(page_nodes(pages, ORDER_TAGS), pages, [Selector("h", "//h1")], tables=Selector("t", "//*[self::table or self::th]")))


@query(f"WITH {BUILT} SELECT page_id, table_no, row_no, col_no, is_header, part_type, text, uri FROM cells")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.extract_tables(page_nodes(built_pages(spark, sf_dir), TABLE_TAGS))


@query(f"WITH {BUILT} SELECT page_id, table_no, text FROM texts")
def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.table_text(parts.extract_tables(page_nodes(built_pages(spark, sf_dir), TABLE_TAGS)))


@query(f"""WITH {BUILT} SELECT page_id, 0 AS kind_order, 0 AS ord, 'Article' AS part_type, 6 AS part_code, CASE WHEN page_id % 6 <> 0 THEN 'Customer ' || page_id || chr(10) END AS text, NULL AS uri FROM (SELECT DISTINCT page_id FROM ord) p
UNION ALL SELECT page_id, 1, table_no, 'Table', 4, text, NULL FROM texts UNION ALL SELECT page_id, 2, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER), 'Link', 2, text, uri FROM anchors
UNION ALL SELECT page_id, 3, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER), 'File', 3, '', uri FROM images""")
def autodetect_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, tables, links and images of pages of orders."""
    return parts.autodetect_parts(page_nodes(built_pages(spark, sf_dir), ORDER_TAGS)).select("page_id", "kind_order", "ord", "part_type", "part_code", "text", "uri")


@query(f"""WITH {BUILT}, h AS (SELECT page_id, html, {HOST.format("url")} AS host, url FROM pages), t AS (SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;', '&'), '\\s*\\n\\s*', ' ', 'g')) || chr(10) AS title FROM pages WHERE regexp_matches(html, '<title>')), {LINKS},
l AS (SELECT page_id, uri, substr(href, 2) AS text, min(ord) AS o FROM found GROUP BY ALL)
SELECT page_id, 0 AS kind_order, 0 AS ord, 'Article' AS part_type, title AS text, NULL AS uri FROM pages LEFT JOIN t USING (page_id) WHERE html <> '' UNION ALL SELECT page_id, 2, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS INTEGER), 'Link', text, uri FROM l""")
def autodetect_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return parts.autodetect_parts(page_nodes(pages)).select("page_id", "kind_order", "ord", "part_type", "text", "uri")


ORDER_SITE = [("o", "0", None, "sub", "Article", "page", None, None), ("o", "0.c", "0", "content", "Text", None, "//body", None), ("o", "0.c.0", "0.c", "sub", "File", "images", "//img", None), ("o", "0.0", "0", "sub", "Table", "orders", None, None)]


@query(f"""WITH {BUILT}, u AS (SELECT page_id, '/s/' || st AS p, site FROM full_ord UNION SELECT page_id, '/i/' || key || '.png', site FROM full_ord WHERE k % 3 <> 1 UNION SELECT page_id, '/f/' || key || '.pdf', site FROM full_ord WHERE k % 3 = 0)
SELECT page_id, site || p AS uri, substr(p, 4) AS file_name FROM u WHERE page_id % 2 = 0""")
def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to download of every other page of orders: of its content and of its tables' cells."""
    pages = built_pages(spark, sf_dir)
    nodes = page_nodes(pages, ORDER_TAGS)
    found, _ = parts.defined_parts(nodes, pages.select("page_id", F.lit("o").alias("config_id")), spark.createDataFrame(ORDER_SITE, parts.DEFINITION))
    return parts.page_manifest(nodes, found, pages.select("page_id", (F.col("page_id") % 2 == 0).alias("download_content")))


#: Three sites' definitions: an article with a menu for content, whose links it wants, and no time; a text with meta data and links; a file that isn't there, a text, and a path that can't be read.
SITES = [
    ("d0", "0", None, "sub", "Article", "page", None, None),
    ("d0", "0.t", "0", "title", "Text", None, "//h1", None),
    ("d0", "0.c", "0", "content", "Text", None, "//nav", None),
    ("d0", "0.c.0", "0.c", "sub", "Link", "menu", None, None),
    ("d0", "0.s", "0", "timestamp", "Text", None, "//time", None),
    ("d1", "0", None, "sub", "Text", "head", "//*[self::title and not(@lang)]", None),
    ("d1", "0.0", "0", "sub", "Meta", None, None, None),
    ("d1", "0.1", "0", "sub", "Link", None, "//a[@href]", None),
    ("d2", "0", None, "sub", "File", "pictures", "//img", None),
    ("d2", "0.0", "0", "sub", "Text", "advert", "//div[@class='ad']", "e"),
    ("d2", "0.1", "0", "sub", "Text", "broken", "//div/p[1]", None),
]
INNER = r"""trim(regexp_replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s*\n\s*', ' ', 'g'))"""


@query(f"""WITH {LINKS}, p AS (SELECT page_id, url, html, 'd' || length({HOST.format("url")}) % 3 AS config_id, {INNER.format("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS h1, {INNER.format("regexp_extract(html, '<nav>(.*?)</nav>', 1, 's')")} AS nav,
  {INNER.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title, {INNER.format("regexp_extract(html, '<div class=.ad.>([^<]*)</div>', 1)")} AS ad FROM pages WHERE url IS NOT NULL),
l AS (SELECT page_id, uri, text, row_number() OVER (PARTITION BY page_id ORDER BY m) - 1 AS o FROM (SELECT page_id, uri, substr(href, 2) AS text, min(ord) AS m FROM found GROUP BY ALL) x),
part AS (
  SELECT page_id, '0' AS part_id, 0 AS ord, false AS missing, h1 || chr(10) AS text FROM p WHERE config_id = 'd0'
  UNION ALL SELECT page_id, '0.t', 0, false, h1 || chr(10) FROM p WHERE config_id = 'd0' UNION ALL SELECT page_id, '0.c', 0, false, nav || chr(10) FROM p WHERE config_id = 'd0'
  UNION ALL SELECT page_id, '0.c.0', o, false, text FROM l JOIN p USING (page_id) WHERE config_id = 'd0' UNION ALL SELECT page_id, '0.s', 0, true, '' FROM p WHERE config_id = 'd0'
  UNION ALL SELECT page_id, '0', 0, false, title || chr(10) FROM p WHERE config_id = 'd1' UNION ALL SELECT page_id, '0.0', 0, false, chr(10) FROM p WHERE config_id = 'd1' UNION ALL SELECT page_id, '0.1', o, false, text FROM l JOIN p USING (page_id) WHERE config_id = 'd1'
  UNION ALL SELECT page_id, '0', 0, true, '' FROM p WHERE config_id = 'd2' UNION ALL SELECT page_id, '0.0', 0, NOT contains(ad, 'e'), CASE WHEN contains(ad, 'e') THEN ad || chr(10) ELSE '' END FROM p WHERE config_id = 'd2')
SELECT page_id, p.config_id, string_agg(part_id || '/' || part.ord || '/' || missing || '/' || part.text, '|' ORDER BY part_id, part.ord) AS parts, any_value(CASE WHEN p.config_id = 'd0' THEN h1 || chr(10) END) AS title,
count(*) FILTER (WHERE part_id IN ('0.c.0', '0.1')) AS n_links, count(*) FILTER (WHERE missing) AS n_anomalies, any_value(page_id % 3 <> 0) AS should_index, any_value(CASE WHEN page_id % 2 = 0 THEN length(html) END) AS raw_length FROM p JOIN part USING (page_id) GROUP BY page_id, p.config_id""")
def crawl_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by its own site's definition, of which there are three."""
    pages = table(spark, sf_dir, "pages").where("url is not null")
    n = F.col("page_id")
    sites = pages.select("page_id", F.concat(F.lit("d"), (F.length(host("url")) % 3).cast("string")).alias("config_id"), (n % 2 == 0).alias("provide_raw"), (n % 3 != 0).alias("should_index"))
    out = parts.crawl_responses(pages, page_nodes(pages), sites, spark.createDataFrame(SITES, parts.DEFINITION))
    shown = F.transform("parts", lambda p: F.concat_ws("/", p["part_id"], p["ord"].cast("string"), p["missing"].cast("string"), F.coalesce(p["text"], F.lit(""))))
    return out.select("page_id", "config_id", F.array_join(shown, "|").alias("parts"), "title", "n_links", "n_anomalies", "should_index", F.length("raw").cast("long").alias("raw_length"))


@query("SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '...' ELSE text END AS summary FROM documents")
def brief_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", brief_summary(F.col("text")).alias("summary"))


@query(r"SELECT page_id, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS name FROM pages")
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", file_name("url").alias("name"))


@query(f"""WITH {LINKS}, r AS (SELECT page_id, url, CASE page_id % 6 WHEN 0 THEN 'All' WHEN 1 THEN 'DomainOnly' WHEN 2 THEN 'TrackLinksOnly' WHEN 3 THEN 'Onetime' WHEN 4 THEN 'Custom' ELSE 'None' END AS s FROM pages WHERE url IS NOT NULL),
a AS (SELECT page_id, url, CASE WHEN s = 'Custom' THEN CASE WHEN length({HOST.format('url')}) % 2 = 0 THEN 'TrackLinksOnly' END ELSE s END AS act FROM r)
SELECT a.url AS base_uri, f.uri, CASE WHEN act = 'TrackLinksOnly' THEN 3 ELSE 1 END AS uri_type FROM a JOIN found f USING (page_id)
WHERE act IN ('All', 'Onetime', 'TrackLinksOnly') OR (act = 'DomainOnly' AND {DOMAIN.format('f.uri')} = {DOMAIN.format('a.url')})""")
def continuation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl events of all pages, with strategies by page id and a custom one for hosts of even length."""
    pages = table(spark, sf_dir, "pages").where("url is not null")
    k = F.col("page_id") % 6
    strategy = F.when(k == 0, "All").when(k == 1, "DomainOnly").when(k == 2, "TrackLinksOnly").when(k == 3, "Onetime").when(k == 4, "Custom").otherwise("None")
    custom = pages.select(host("url").alias("match")).distinct().where("length(match) % 2 = 0").withColumn("strategy", F.lit("TrackLinksOnly"))
    events, _ = lk.apply_continuation(pages.select("page_id", F.col("url").alias("uri"), strategy.alias("strategy")), lk.continuation_links(parts.page_links(shred_html(pages, tags=["a"]), pages)), custom)
    return events


SITE = f"LEFT JOIN config c ON c.host = {HOST.format('u.uri')} AND NOT c.is_collector"


@query(f"""WITH {URIS}, {CONFIG} SELECT u.id, u.uri, c.id AS config_id, coalesce(c.document, 'AutoDetect') AS document, CASE WHEN c.id IS NULL THEN 2 ELSE c.continuation END AS continuation,
CASE WHEN c.id IS NULL THEN true ELSE c.should_index END AS should_index, CASE WHEN c.id IS NULL THEN true ELSE c.provide_raw END AS provide_raw, coalesce(c.download_content, false) AS download_content FROM uris u {SITE}""")
def create_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.create_requests(page_uris(spark, sf_dir).select("id", "uri"), site_config(spark, sf_dir))


@query(f"WITH {URIS}, {CONFIG} SELECT u.id, u.uri, c.id AS config_id, coalesce(c.document, 'AutoDetect') AS document, 4 AS continuation FROM uris u LEFT JOIN config c ON c.host = {HOST.format('u.uri')} AND c.is_collector")
def create_collector_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.create_collector_requests(page_uris(spark, sf_dir).select("id", "uri"), site_config(spark, sf_dir))


@query(f"WITH {URIS}, {CONFIG} SELECT u.id, {SKIP.format('u.uri')} AS skip FROM uris u LEFT JOIN config c ON c.host = {HOST.format('u.base_uri')} AND NOT c.is_collector")
def should_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.should_skip(page_uris(spark, sf_dir), site_config(spark, sf_dir)).select("id", "skip")


@query(f"WITH {URIS}, {CONFIG} SELECT u.id, coalesce(regexp_matches(u.uri, c.collectable_pattern), false) AS collectable FROM uris u {SITE}")
def is_collectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cfg.is_collectable(page_uris(spark, sf_dir), site_config(spark, sf_dir)).select("id", "collectable")


INGEST = f"""{URIS}, {CONFIG}, {EVENTS}, known AS (SELECT DISTINCT lower(uri) AS k FROM uris WHERE page_id % 10 = 0), answered AS (SELECT DISTINCT url FROM pages WHERE page_id % 11 = 0),
e AS (SELECT ev.*, lower(ev.uri) AS k, coalesce(ev.base_uri, lower(ev.uri)) AS base, ev.uri IN (SELECT url FROM answered) AS done, lower(ev.uri) IN (SELECT k FROM known) AS old FROM ev),
s AS (SELECT *, max(CASE WHEN NOT done AND (uri_type = 1 OR NOT old) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
o AS (SELECT s.*, CASE WHEN done THEN 'response_exists' WHEN uri_type <> 1 AND (old OR coalesce(before, 0) = 1) THEN 'duplicate_uri' WHEN uri_type <> 1 AND {SKIP.format('s.k')} THEN 'skipped' ELSE 'new_uri' END AS outcome
  FROM s LEFT JOIN config c ON c.host = {HOST.format('s.base')} AND NOT c.is_collector)"""


def _ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    known = page_uris(spark, sf_dir).where("cast(id as long) % 10 = 0")
    return fr.ingest_uris(crawl_events(spark, sf_dir), known, pages.where("page_id % 11 = 0").select(F.col("url").alias("uri")), site_config(spark, sf_dir))


@query(f"WITH {INGEST} SELECT event_id, outcome, CASE WHEN outcome IN ('new_uri', 'skipped') THEN k END AS uri, CASE WHEN outcome IN ('new_uri', 'skipped') THEN base END AS base_uri, uri_type, outcome = 'skipped' AS is_skipped FROM o")
def ingest_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir).drop("is_completed")


@query(f"WITH {INGEST} SELECT outcome, count(*) AS n FROM o GROUP BY 1")
def ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.ingest_counts(_ingested(spark, sf_dir))


@query(f"WITH {LINKS} SELECT uri, min(base_uri) AS base_uri, 3 AS uri_type FROM found WHERE uri NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY uri")
def store_detected_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rows, _ = fr.store_detected_urls(parts.page_links(shred_html(pages, tags=["a"]), pages), page_uris(spark, sf_dir))
    return rows.select("uri", "base_uri", "uri_type")


@query(f"WITH {URIS}, {EVENTS} SELECT event_id, uri FROM ev WHERE uri IN (SELECT uri FROM uris)")
def existing_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.existing(crawl_events(spark, sf_dir), page_uris(spark, sf_dir)).select("event_id", "uri")


WORK = "work AS (SELECT CAST(event_id AS VARCHAR) AS id, lpad(CAST(user_id AS VARCHAR), 12, '0') AS uri_id, CASE WHEN event_id % 3 = 0 THEN ts END AS scheduled_at, event_id FROM events)"


def _work(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").cast("string").alias("id"), F.lpad(F.col("user_id").cast("string"), 12, "0").alias("uri_id"), F.when(F.col("event_id") % 3 == 0, F.col("ts").cast("timestamp")).alias("scheduled_at"), F.lit(None).cast("timestamp").alias("completed_at"))


@query(f"WITH {URIS}, {WORK} SELECT w.id, w.uri_id, CASE WHEN u.id IS NULL THEN 'unknown uri_id' END AS error FROM work w LEFT JOIN (SELECT DISTINCT id FROM uris) u ON u.id = w.uri_id")
def guard_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = fr.guard_work(_work(spark, sf_dir), page_uris(spark, sf_dir))
    return good.withColumn("error", F.lit(None).cast("string")).unionByName(bad).select("id", "uri_id", "error")


@query(f"""WITH {URIS} SELECT 'periodic' AS pass, id FROM uris WHERE uri_type = 2 AND cron IS NOT NULL UNION ALL SELECT 'collector', id FROM uris WHERE uri_type = 5 AND cron IS NOT NULL
UNION ALL (SELECT 'new_collector', id FROM uris WHERE uri_type = 5 AND cron IS NULL AND NOT is_completed ORDER BY id LIMIT 10) UNION ALL (SELECT 'found', id FROM uris WHERE uri_type = 3 AND NOT is_completed ORDER BY id LIMIT 100)
UNION ALL (SELECT 'onetime', id FROM uris WHERE uri_type = 1 AND NOT is_completed ORDER BY id LIMIT 100)""")
def frontier_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = page_uris(spark, sf_dir)
    out = None
    for name, rows in (("periodic", fr.periodic(uri)), ("collector", fr.collectors(uri)), ("new_collector", fr.new_collectors(uri)), ("found", fr.found(uri)), ("onetime", fr.onetime(uri))):
        rows = rows.select(F.lit(name).alias("pass"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {WORK} SELECT id FROM work WHERE scheduled_at IS NULL ORDER BY id LIMIT 200")
def unscheduled_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.unscheduled(_work(spark, sf_dir)).select("id")


FOUND = f"""{URIS}, {CONFIG}, j AS (SELECT u.*, {SKIP.format('u.uri')} AS skip, coalesce(regexp_matches(u.uri, c.collectable_pattern), false) AS col FROM uris u LEFT JOIN config c ON c.host = {HOST.format('u.base_uri')} AND NOT c.is_collector WHERE u.uri_type IN (1, 3) AND NOT u.is_completed)"""


@query(f"WITH {FOUND} SELECT id, CASE WHEN NOT skip AND col THEN 5 ELSE uri_type END AS uri_type, skip AS is_skipped, skip OR NOT col AS is_completed FROM j")
def process_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, _ = fr.process_found(page_uris(spark, sf_dir).where("uri_type in (1, 3) and not is_completed"), site_config(spark, sf_dir))
    return rows.select("id", "uri_type", "is_skipped", "is_completed")


@query(f"WITH {FOUND} SELECT CASE WHEN skip THEN 'skipped' WHEN col THEN 'collector' ELSE 'schedule_crawl' END AS label, count(*) AS n FROM j GROUP BY 1")
def process_found_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.process_found(page_uris(spark, sf_dir).where("uri_type in (1, 3) and not is_completed"), site_config(spark, sf_dir))[2]


@query(f"WITH {URIS}, {CONFIG} SELECT u.id, coalesce(c.document, 'AutoDetect') AS document FROM uris u {SITE} WHERE u.uri_type = 1 AND NOT u.is_completed")
def process_onetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, _ = fr.process_onetime(page_uris(spark, sf_dir).where("uri_type = 1 and not is_completed"), site_config(spark, sf_dir))
    return requests.select("id", "document")


@query(f"WITH {URIS}, {CONFIG}, {WORK} SELECT w.id, u.uri, coalesce(c.document, 'AutoDetect') AS document FROM work w JOIN uris u ON u.id = w.uri_id {SITE} WHERE w.scheduled_at IS NULL")
def schedule_unscheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests, _, _ = fr.schedule_unscheduled(_work(spark, sf_dir), page_uris(spark, sf_dir), site_config(spark, sf_dir), AS_OF)
    return requests.select("id", "uri", "document")


@query(f"WITH {WORK} SELECT id, CASE WHEN event_id % 4 = 0 THEN '2024-01-15 12:00:00' END AS completed_at FROM work")
def complete_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = table(spark, sf_dir, "events").where("event_id % 4 = 0").select(F.col("event_id").cast("string").alias("id"))
    return fr.complete_crawls(_work(spark, sf_dir), finished, AS_OF).select("id", stamp("completed_at").alias("completed_at"))


@query(f"WITH {URIS} SELECT id AS uri_id, strftime(t, '%Y-%m-%d %H:%M:%S') AS due_at FROM uris, (SELECT TIMESTAMP '2024-01-15 06:30:00' + INTERVAL (d) DAY + INTERVAL (s * 15) SECOND AS t FROM range(3) a(d), range(4) b(s)) x WHERE uri_type = 2 AND cron IS NOT NULL")
def periodic_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work for every firing of the periodic rows in three days."""
    due = schedule.periodic_pass(page_uris(spark, sf_dir), datetime(2024, 1, 15), datetime(2024, 1, 18))
    return due.select("uri_id", stamp("due_at").alias("due_at"))


@query(f"WITH {URIS}, {CONFIG} SELECT u.id, coalesce(c.document, 'AutoDetect') AS document, 4 AS continuation, count(*) AS n FROM uris u LEFT JOIN config c ON c.host = {HOST.format('u.uri')} AND c.is_collector, range(4) x WHERE u.uri_type = 5 AND u.cron IS NOT NULL GROUP BY ALL")
def collector_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = schedule.collector_pass(page_uris(spark, sf_dir), site_config(spark, sf_dir), datetime(2024, 1, 15), datetime(2024, 1, 16))
    return due.groupBy("id", "document", "continuation").agg(F.count("*").alias("n"))


@query(f"WITH {URIS} SELECT id, CASE WHEN contains(uri, '/de/') OR contains(uri, '/es/') THEN 'ignore' WHEN contains(uri, '/fr/') OR contains(uri, '.html') THEN 'onetime' ELSE 'manual' END AS action FROM uris WHERE uri_type = 5")
def triage_collectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.triage_collectors(page_uris(spark, sf_dir).where("uri_type = 5"), ["/de/", "/es/"], ["/fr/", ".html"]).select("id", "action")


@query(f"SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'request*' WHEN {HOST.format('url')} <> '' THEN {HOST.format('url')} ELSE url END AS routing_key FROM pages")
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fr.route_key(F.col("url"), F.col("page_id") % 9 == 0).alias("routing_key"))


@query("""WITH r AS (SELECT event_id AS id, 'h' || (user_id % 50) || '.example.com' AS host, ts FROM events), w AS (SELECT *, CASE WHEN host = 'h7.example.com' THEN 2 ELSE 5 END AS delay FROM r),
l AS (SELECT 'h' || u || '.example.com' AS host, u % 15 AS ago FROM range(25) x(u)),
s AS (SELECT id, w.host, delay, sum(delay) OVER (PARTITION BY w.host ORDER BY ts, id ROWS UNBOUNDED PRECEDING) - CASE WHEN l.ago IS NULL THEN delay ELSE least(delay, l.ago) END AS wait FROM w LEFT JOIN l ON l.host = w.host)
SELECT id, host, delay, strftime(TIMESTAMP '2024-01-15 12:00:00' + to_seconds(CAST(wait AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS fetch_at FROM s""")
def plan_fetch_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polite plan for all events as requests: 5 s a host, 2 s for one of them, some asked lately."""
    e = table(spark, sf_dir, "events")
    name = F.concat(F.lit("h"), (F.col("user_id") % 50).cast("string"), F.lit(".example.com"))
    requests = e.select(F.col("event_id").alias("id"), F.concat(F.lit("https://"), name, F.lit("/x")).alias("uri"), F.col("ts").cast("timestamp").alias("enqueued_at"))
    hosts = spark.range(25).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".example.com")).alias("host"), (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 15).cast("decimal(18,6)"))).alias("at"))
    limits = spark.range(1).select(F.lit("h7.example.com").alias("host"), F.lit(2).alias("min_s"), F.lit(2).alias("max_s"))
    return fr.plan_fetch_times(requests, limits, hosts, AS_OF, default=(5, 5)).select("id", "host", "delay", stamp("fetch_at").alias("fetch_at"))


@query("SELECT 'h' || user_id || '.example.com' AS host, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY 1 HAVING max(ts) > TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 86400 SECOND")
def last_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example.com/")).alias("uri"), F.col("ts").cast("timestamp").alias("at"))
    return fr.last_requests(e, datetime(2024, 1, 30, 12), 86400).select("host", stamp("at").alias("at"))


@query("SELECT user_id AS crawl_id, arg_max(event_type, ts) AS status FROM events GROUP BY 1")
def crawl_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("crawl_id"), F.col("event_type").alias("status"), F.col("ts").alias("at"))
    return fr.crawl_status(e).select("crawl_id", "status")


def _text_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as responses; every third is an article, whose texts are its lines."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    res = d.select(key.alias("id"), F.concat(F.lit("https://docs.example.com/"), key).alias("uri"), F.when(F.col("doc_id") % 2 == 0, key).alias("correlation_id"), F.col("source").alias("crawler_id"), F.lit(AS_OF).cast("timestamp").alias("timestamp"), (F.col("doc_id") % 4 != 0).alias("should_index"))
    third = F.col("doc_id") % 3 == 0
    lines = d.select(key.alias("response_id"), third.alias("third"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    texts = lines.select("response_id", F.concat(F.lit("t"), F.col("ord").cast("string")).alias("part_id"), F.when(F.col("third"), F.lit("a")).alias("owner_id"), (F.col("ord") + 1).alias("ord"), F.lit("Text").alias("part_type"), F.when(F.col("third") & (F.col("ord") == 0), F.lit("Heading")).alias("name"), "text", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("uri"))
    articles = d.where(third).select(key.alias("response_id"), F.lit("a").alias("part_id"), F.lit(None).cast("string").alias("owner_id"), F.lit(0).alias("ord"), F.lit("Article").alias("part_type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("text"), F.col("lang").alias("title"), F.lit(None).cast("string").alias("uri"))
    return res, texts.unionByName(articles)


DOCS = """l AS (SELECT doc_id, lang, source, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)) AS lines, string_split(coalesce(text, ''), chr(10))[1] AS head FROM documents WHERE doc_id % 4 <> 0),
b AS (SELECT *, array_to_string(list_transform(list_filter(CASE WHEN doc_id % 3 = 0 THEN lines[2:] ELSE lines END, lambda x: x <> ''), lambda x: x || chr(10)), '') AS content FROM l)"""


@query(f"""WITH {DOCS} SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS correlation_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS title, CASE WHEN doc_id % 3 = 0 THEN head ELSE '' END AS heading, content,
'2024-01-15T12:00:00.000' AS timestamp FROM b WHERE NOT (doc_id % 3 = 0 AND content = '')""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = responses.search_documents(*_text_parts(spark, sf_dir), AS_OF)
    return docs.select("id", "correlation_id", "title", "heading", "content", "timestamp")


@query(f"WITH {DOCS} SELECT CAST(doc_id AS VARCHAR) AS id, 'article without content' AS error FROM b WHERE doc_id % 3 = 0 AND content = ''")
def search_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.search_documents(*_text_parts(spark, sf_dir), AS_OF)[1].select("id", "error")


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, '2024.01.15:12:00:00' AS timestamp, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS title,
CASE WHEN doc_id % 3 = 0 THEN array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: x || '. ' || chr(10)), '') ELSE '' END AS text FROM documents""")
def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.index_documents(*_text_parts(spark, sf_dir), AS_OF).select("id", "timestamp", "title", "text")


@query("SELECT CAST(event_id AS VARCHAR) AS id, 'failed ' || event_id || chr(10) || props AS text, 'https://h' || user_id || '.example.com/' AS error_uri FROM events WHERE event_type = 'error'")
def failure_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    key = F.col("event_id").cast("string")
    failed = e.select(key.alias("id"), F.lit(None).cast("string").alias("crawler_id"), F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example.com/")).alias("uri"), F.concat(F.lit("failed "), key).alias("message"), F.col("props").alias("stack"))
    return responses.failure_documents(failed).select("id", "text", "error_uri")


ROUTES = [ex.Route("key", "view", "store"), ex.Route("key", "view*", "never"), ex.Route("type", "T.click", "search"), ex.Route("type", "T.view", "search"), ex.Route("url", "H1.EXAMPLE", "local"), ex.Route("type", "T.error", "off"), ex.Route("key", "view", "store")]


@query(f"""WITH {MESSAGES} SELECT id, coalesce(correlation_id, id) AS correlation_id, 'store' AS target FROM msg WHERE routing_key = 'view' UNION ALL SELECT id, coalesce(correlation_id, id), 'search' FROM msg WHERE payload_type IN ('T.click', 'T.view')
UNION ALL SELECT id, coalesce(correlation_id, id), 'local' FROM msg WHERE event_id % 10 <> 0 AND contains(payload, 'h1.example')""")
def route_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages to targets by key, type and url text; one target is switched off."""
    off = spark.range(1).select(F.lit("x").alias("exchange"), F.lit("publisher").alias("kind"), F.lit("off").alias("name"), F.lit(False).alias("is_active"))
    routed = ex.route(ex.envelope(messages(spark, sf_dir).drop("ts")), ex.routes_table(spark, ROUTES), off)
    return routed.select("id", "correlation_id", "target")


@query(f"WITH {MESSAGES} SELECT id FROM msg WHERE payload_type NOT IN ('T.view', 'T.click') AND NOT (event_id % 10 <> 0 AND contains(payload, 'h1.example'))")
def unrouted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ex.envelope(messages(spark, sf_dir).drop("ts"))
    return ex.unrouted(m, ex.route(m, ex.routes_table(spark, [r for r in ROUTES if r.target != "off"]))).select("id")


def _transformed(m: DataFrame) -> DataFrame:
    bad = F.col("payload_type") == "T.error"
    return m.withColumn("error", F.when(bad, F.lit("refused"))).withColumn("payload", F.when(F.col("payload_type") != "T.signup", F.col("payload"))).withColumn("routing_key", F.lit("out"))


def _exchange(spark: SparkSession, sf_dir: str) -> ex.ExchangeResult:
    routes = ex.routes_table(spark, [ex.Route("type", f"T.{t}", "mark") for t in ("view", "click", "error", "signup")])
    return ex.Exchange("x", [ex.Transformer("mark", _transformed)], [ex.Publisher("a"), ex.Publisher("b")], inbound=routes, max_hops=1).run(messages(spark, sf_dir).drop("ts"))


@query(f"""WITH {MESSAGES}, t AS (SELECT * FROM msg WHERE payload_type IN ('T.view', 'T.click')), o AS (SELECT id, payload FROM t WHERE event_id % 10 <> 0 UNION ALL SELECT id || '-1.mark-0', 'a' || event_id FROM t WHERE event_id % 10 = 0 UNION ALL SELECT id || '-1.mark-1', 'b' FROM t WHERE event_id % 10 = 0)
SELECT id, payload, target FROM o, (VALUES ('a'), ('b')) x(target)""")
def exchange_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exchange(spark, sf_dir).published.select("id", "payload", "target")


def _prefixed(name: str) -> ex.Transformer:
    return ex.Transformer(name, lambda m: m.withColumn("payload", F.concat(F.lit(f"{name}:"), "payload")).withColumn("payload_type", F.lit(name)))


@query(f"""WITH {MESSAGES}, o AS (SELECT id, unnest(['a:' || payload, 'b:' || payload, 'b:a:' || payload]) AS payload, unnest(['p', 'q', 'q']) AS target FROM msg WHERE payload_type = 'T.view'
UNION ALL SELECT id, 'b:' || payload, 'q' FROM msg WHERE payload_type = 'T.click') SELECT id, payload, target FROM o""")
def exchange_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transformers, one of which also takes what the other makes, and routes to the publishers: outputs of one message share its id, none is lost."""
    inbound = ex.routes_table(spark, [ex.Route("type", "T.view", "a"), ex.Route("type", "T.view", "b"), ex.Route("type", "T.click", "b"), ex.Route("type", "a", "b")])
    outbound = ex.routes_table(spark, [ex.Route("type", "a", "p"), ex.Route("type", "b", "q")])
    exchange = ex.Exchange("x", [_prefixed("a"), _prefixed("b")], [ex.Publisher("p"), ex.Publisher("q")], inbound=inbound, outbound=outbound, max_hops=2)
    return exchange.run(messages(spark, sf_dir).drop("ts")).published.select("id", "payload", "target")


def _lists(name: str) -> ex.Transformer:
    return ex.Transformer(name, lambda m: m.withColumn("payload", F.to_json(F.array(F.concat(F.lit(f"{name}:"), "payload"), F.lit(name)))).withColumn("payload_type", F.lit("item")))


@query(f"""WITH {MESSAGES}, l AS (SELECT id, t, payload, 1 AS hop FROM msg, (VALUES ('x'), ('y')) v(t) WHERE payload_type = 'T.view' UNION ALL SELECT id, t, 'a:' || payload, 2 FROM msg, (VALUES ('x'), ('y')) v(t) WHERE payload_type = 'T.click')
SELECT id || '-' || hop || '.' || t || '-' || k AS id, CASE k WHEN 0 THEN t || ':' || payload ELSE t END AS payload, 'p' AS target FROM l, (VALUES (0), (1)) p(k) UNION ALL SELECT id, 'a:' || payload, 'p' FROM msg WHERE payload_type IN ('T.click', 'T.error')
UNION ALL SELECT id, 'a:a:' || payload, 'p' FROM msg WHERE payload_type = 'T.error'""")
def exchange_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of two transformers, in the first hop and in the second: every item has an id of its own and isn't transformed again."""
    return _list_exchange(spark, sf_dir).published.select("id", "payload", "target")


def _list_exchange(spark: SparkSession, sf_dir: str) -> ex.ExchangeResult:
    again = ex.Transformer("a", lambda m: m.withColumn("payload", F.concat(F.lit("a:"), "payload")).withColumn("payload_type", F.when(F.col("payload_type") == "T.click", F.lit("made")).otherwise(F.col("payload_type"))))
    inbound = ex.routes_table(spark, [ex.Route("type", t, name) for t in ("T.view", "made") for name in ("x", "y")] + [ex.Route("type", "T.click", "a"), ex.Route("type", "T.error", "a"), ex.Route("type", "item", "x")])
    return ex.Exchange("l", [_lists("x"), _lists("y"), again], [ex.Publisher("p")], inbound=inbound, max_hops=2).run(messages(spark, sf_dir).drop("ts"))


@query(f"WITH {MESSAGES} SELECT id, 'a:a:' || payload AS payload, 'hops' AS stage, 'a' AS target, 'stopped after 2 hops' AS error FROM msg WHERE payload_type = 'T.error'")
def exchange_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would go through the transformers for ever is a dead letter after two hops."""
    return _list_exchange(spark, sf_dir).deadletters.select("id", "payload", "stage", "target", "error")


@query(f"""WITH {MESSAGES} SELECT id, 'transform' AS stage, 'mark' AS target, 'refused' AS error FROM msg WHERE payload_type = 'T.error'
UNION ALL SELECT id, 'hops', 'mark', 'stopped after 1 hops' FROM msg WHERE payload_type IN ('T.view', 'T.click') AND event_id % 10 <> 0""")
def exchange_deadletters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exchange(spark, sf_dir).deadletters.select("id", "stage", "target", "error")


@query(f"WITH {MESSAGES} SELECT id FROM msg WHERE given IS NULL OR NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id = msg.event_id AND e.value > 20)")
def outstanding_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "events").where("value > 20").select(F.col("event_id").cast("string").alias("id"))
    return ex.outstanding(ex.envelope(messages(spark, sf_dir).drop("ts")), done).select("id")


@query("""WITH d AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'CrawlRequest' WHEN 'click' THEN 'CrawlUri' ELSE 'Other' END AS t, 'https://h' || user_id || '.example.com/' AS u, event_id % 2 = 0 AS based FROM events)
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN t = 'Other' OR regexp_matches(u, 'h[0-9]*[05]\\.') THEN 'drop' WHEN t = 'CrawlRequest' OR based THEN 'republish' ELSE 'keep' END AS action FROM d""".replace("\\\\", "\\"))
def replay_deadletters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    uri = F.concat(F.lit("https://h"), F.col("user_id").cast("string"), F.lit(".example.com/"))
    kind = F.when(F.col("event_type") == "view", "CrawlRequest").when(F.col("event_type") == "click", "CrawlUri").otherwise("Other")
    payload = F.to_json(F.struct(F.array(uri).alias("uri"), F.when(F.col("event_id") % 2 == 0, uri).alias("base_uri")))
    letters = e.select(F.col("event_id").cast("string").alias("id"), kind.alias("payload_type"), payload.alias("payload"))
    answered = e.where("user_id % 5 = 0").select(uri.alias("uri"))
    out = None
    for action, rows in zip(("republish", "keep", "drop"), ex.replay_deadletters(letters, answered), strict=True):
        rows = rows.select("id", F.lit(action).alias("action"))
        out = rows if out is None else out.unionByName(rows)
    return out


STAGED = "CASE event_id % 4 WHEN 0 THEN 'incoming' WHEN 1 THEN 'transformed' WHEN 2 THEN 'published' ELSE 'error' END"


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    stage = F.when(k == 0, "incoming").when(k == 1, "transformed").when(k == 2, "published").otherwise("error")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("payload_type"), stage.alias("stage"), "ts", "user_id", "event_id", "value")


@query(f"SELECT event_type AS payload_type, count(*) FILTER (WHERE s = 'incoming') AS incoming, count(*) FILTER (WHERE s = 'transformed') AS transformed, count(*) FILTER (WHERE s = 'published') AS published, count(*) FILTER (WHERE s = 'error') AS error FROM (SELECT *, {STAGED} AS s FROM events) x GROUP BY 1")
def message_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.funnel(_staged(spark, sf_dir))


@query(f"SELECT {STAGED} AS stage, event_type AS payload_type, count(*) AS n FROM events GROUP BY ALL")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.stage_counts(_staged(spark, sf_dir))


@query("SELECT 'h' || user_id AS host, count(*) FILTER (WHERE event_id % 3 = 0) AS started, count(*) FILTER (WHERE event_id % 3 = 1) AS completed, count(*) FILTER (WHERE event_id % 3 = 2) AS failed FROM events GROUP BY 1")
def crawl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("host"), F.when(k == 0, "started").when(k == 1, "completed").otherwise("failed").alias("outcome"))
    return metrics.crawl_outcomes(e)


@query("SELECT event_type AS job, count(*) AS n, CAST(round(sum(CAST(event_id % 90 AS DOUBLE)) / count(*), 6) AS DOUBLE) AS mean_s FROM events GROUP BY 1")
def mean_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("job"), start.alias("started_at"), (start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("event_id") % 90).cast("decimal(18,6)"))).alias("ended_at"))
    return metrics.mean_duration(e).withColumn("mean_s", F.round("mean_s", 6))


@query("SELECT strftime(time_bucket(INTERVAL 30 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS payload_type, count(*) AS n FROM events GROUP BY ALL")
def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.jobs import live_counters as counters

    e = _staged(spark, sf_dir).withColumn("stage", F.lit("in")).withColumn("ts", F.col("ts").cast("timestamp"))
    return counters(e).select(stamp("start").alias("start"), "payload_type", "n")


@query("SELECT doc_id AS id, lang, source FROM documents WHERE (lang = 'en' AND source >= 'src3') OR regexp_matches(source, '1$') ORDER BY doc_id LIMIT 50 OFFSET 5")
def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    filters = [{"Eq": {"FieldName": "lang", "FilterValue": "en"}}, {"And": {"Gte": {"FieldName": "source", "FilterValue": "src3"}}}, {"Or": {"Regex": {"FieldName": "source", "FilterValue": "1$"}}}]
    return dt.read_documents(d, filters, limit=50, skip=5)


@query("SELECT event_id FROM events WHERE CAST(user_id AS VARCHAR) > '5' AND event_type IN ('view', 'click') OR regexp_matches(props, '9')")
def filtered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = [{"Gt": {"FieldName": "user_id", "FilterValue": "5"}}, {"In": {"FieldName": "event_type", "FilterValue": ["view", "click"]}}, {"Or": {"Regex": {"FieldName": "props", "FilterValue": "9"}}}]
    return table(spark, sf_dir, "events").where(compile_filters(f)).select("event_id")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    old, then = F.lit(datetime(2023, 1, 1)).cast("timestamp"), F.lit(None).cast("timestamp")
    base = d.where("doc_id % 3 != 0").select(F.col("doc_id").alias("id"), "lang", old.alias("created"), then.alias("updated"))
    new = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), F.upper("lang").alias("lang"))
    return base, new


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 3 <> 0 THEN '2023-01-01 00:00:00' ELSE '2024-01-15 12:00:00' END AS created,
CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN '2024-01-15 12:00:00' END AS updated FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0""")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.upsert(*_versions(spark, sf_dir), AS_OF).select("id", "lang", stamp("created").alias("created"), stamp("updated").alias("updated"))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'third' WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 3 <> 0 THEN '2023-01-01 00:00:00' WHEN doc_id % 2 = 0 THEN '2024-01-15 12:00:00' ELSE '2024-02-01 00:00:00' END AS created,
CASE WHEN doc_id % 7 = 0 THEN CASE WHEN doc_id % 3 <> 0 OR doc_id % 2 = 0 THEN '2024-02-01 00:00:00' END WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN '2024-01-15 12:00:00' END AS updated FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0 OR doc_id % 7 = 0""")
def upsert_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed table made of documents, then updated twice, each time in the buckets that the updates touch."""
    d = table(spark, sf_dir, "documents")
    stored = BucketedTable(scratch(spark), "id long, lang string", buckets=64)
    row = lambda where, lang: d.where(where).select(F.col("doc_id").alias("id"), lang.alias("lang"))
    stored.upsert(row("doc_id % 3 != 0", F.col("lang")), datetime(2023, 1, 1))
    stored.upsert(row("doc_id % 2 = 0", F.upper("lang")), AS_OF)
    stored.upsert(row("doc_id % 7 = 0", F.lit("third")), datetime(2024, 2, 1))
    return stored.read(spark).select("id", "lang", stamp("created").alias("created"), stamp("updated").alias("updated"))


@query("SELECT doc_id FROM documents WHERE NOT (doc_id % 5 = 0) AND NOT coalesce(lang = 'fr', false)")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    left = dt.delete_ids(d, d.where("doc_id % 5 = 0"), "doc_id")
    return dt.delete_where(left, [{"Eq": {"FieldName": "lang", "FilterValue": "fr"}}]).select("doc_id")


@query("SELECT 'h-' || event_id AS _id, event_type, value FROM events WHERE event_id % 7 <> 0")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search bodies of one hit for each event, some of which don't decode, read back."""
    e = table(spark, sf_dir, "events")
    source = F.when(F.col("event_id") % 7 == 0, F.lit('"broken"')).otherwise(F.to_json(F.struct("event_type", "value")))
    body = F.concat(F.lit('{"hits":{"hits":[{"_id":"h-'), F.col("event_id").cast("string"), F.lit('","_source":'), source, F.lit("}]}}"))
    return dt.parse_search_hits(e.select(body.alias("body")), "event_type string, value double")


@query(r"""SELECT doc_id, CAST(len(list_filter(['the', 'und', 'que'], lambda q: list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), q))) AS INTEGER) AS score FROM documents
WHERE len(list_filter(['the', 'und', 'que'], lambda q: list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), q))) > 0""")
def match_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dt.match_text(table(spark, sf_dir, "documents"), "text", "The und QUE").select("doc_id", "score")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id AS VARCHAR) AS correlation_id, event_type AS routing_key FROM events")
def to_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("routing_key"), "value")
    return dt.to_messages(e, "Event", "default").select("id", "correlation_id", "routing_key")


@query("""SELECT CAST(event_id AS VARCHAR) AS id, p.part_id, p.parent_id, p.depth, CASE p.depth WHEN 0 THEN 'Article' ELSE 'Text' END AS part_type, CASE p.depth WHEN 0 THEN event_type ELSE 'n' || p.part_id END AS name FROM events,
(VALUES ('0', NULL, 0), ('0.0', '0', 1), ('0.1', '0', 1), ('0.1.0', '0.1', 2), ('0.1.0.0', '0.1.0', 3), ('0.1.0.0.0', '0.1.0.0', 4), ('0.1.0.0.0.0', '0.1.0.0.0', 5)) p(part_id, parent_id, depth)""")
def decode_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part definitions with plain and list values, nested six deep, built from events and flattened."""
    inner = '{"DocPartType":1,"Name":"n0.1.0.0.0.0"}'
    for name in ("n0.1.0.0.0", "n0.1.0.0", "n0.1.0"):
        inner = f'{{"DocPartType":[1],"Name":["{name}"],"SubParts":[[{inner}]]}}'
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"DocPartType":[6],"Name":["'), "event_type", F.lit('"],"SubParts":[[{"docPartType":1,"Name":"n0.0"},{"DocPartType":[1],"Name":["n0.1"],"SubParts":[[' + inner + ']]}]]}'))
    return dt.decode_parts(e.select(F.col("event_id").cast("string").alias("id"), text.alias("j")), "j").select("id", "part_id", "parent_id", "depth", "part_type", "name")


@query(f"WITH {URIS} SELECT DISTINCT cron, strftime(TIMESTAMP '2024-01-15 06:30:00' + INTERVAL (s * 15) SECOND, '%Y-%m-%d %H:%M:%S') AS fires_at FROM uris, range(4) x(s) WHERE cron IS NOT NULL")
def cron_firings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return firings(page_uris(spark, sf_dir), "cron", datetime(2024, 1, 15), datetime(2024, 1, 16)).select("cron", stamp("fires_at").alias("fires_at"))


def _crons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kinds = ["L * ?", "LW * ?", "? * 6L", "15W * ?", "? * MON-WED", "1/10 2-3 ? 2024", "40 * ?", "? JAN X"]
    day = F.element_at(F.array(*map(F.lit, kinds)), (n % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(F.concat_ws(" ", F.lit("0"), (n % 60).cast("string"), (F.col("user_id") % 24).cast("string"), day).alias("cron"))


CRONS = """crons AS (SELECT DISTINCT event_id % 60 AS mi, user_id % 24 AS ho, event_id % 8 AS kind, '0 ' || event_id % 60 || ' ' || user_id % 24 || ' ' || ['L * ?', 'LW * ?', '? * 6L', '15W * ?', '? * MON-WED', '1/10 2-3 ? 2024', '40 * ?', '? JAN X'][event_id % 8 + 1] AS cron FROM events)"""


@query(f"""WITH {CRONS}, days AS (SELECT d, last_day(d) AS last, isodow(d) AS dow FROM (SELECT CAST(DATE '2024-01-01' + CAST(i AS INTEGER) AS DATE) AS d FROM range(91) r(i)) x),
fit AS (SELECT d, k FROM days, range(6) r(k) WHERE (k = 0 AND d = last) OR (k = 1 AND d = last - CASE isodow(last) WHEN 6 THEN 1 WHEN 7 THEN 2 ELSE 0 END) OR (k = 2 AND dow = 5 AND month(d + 7) <> month(d))
  OR (k = 3 AND day(d) = 15 + CASE isodow(date_trunc('month', d) + INTERVAL 14 DAY) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END) OR (k = 4 AND dow BETWEEN 1 AND 3) OR (k = 5 AND month(d) IN (2, 3) AND day(d) % 10 = 1))
SELECT cron, strftime(CAST(d AS TIMESTAMP) + to_hours(ho) + to_minutes(mi), '%Y-%m-%d %H:%M:%S') AS fires_at FROM crons JOIN fit ON k = kind""")
def cron_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Very many expressions, with last days, nearest weekdays, last Fridays, spans and a year, over a quarter."""
    return firings(_crons(spark, sf_dir), "cron", datetime(2024, 1, 1), datetime(2024, 4, 1)).select("cron", stamp("fires_at").alias("fires_at"))


@query(f"WITH {CRONS} SELECT cron, CASE kind WHEN 6 THEN '40 isn''t in 1..31' ELSE 'not a number: ' || chr(39) || 'X' || chr(39) END AS error FROM crons WHERE kind >= 6")
def cron_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cron_rejects(_crons(spark, sf_dir), "cron")


@query("SELECT 'good' AS row, CAST(c_custkey AS BIGINT) AS custkey, c_name AS name FROM customer")
def csv_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CSV in the shared folder, read back as maps; no line is bad."""
    folder = scratch(spark)
    write_csv_maps(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), folder)
    good, bad = read_csv_maps(spark, folder)
    rows = good.select(F.lit("good").alias("row"), F.col("data")["c_custkey"].cast("long").alias("custkey"), F.col("data")["c_name"].alias("name"))
    return rows.unionByName(bad.select(F.lit("bad").alias("row"), F.lit(None).cast("long").alias("custkey"), F.col("line").alias("name")))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a stream in several batches into a batch table, each batch written twice as if it had come back."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    folder = scratch(spark)
    e.repartition(3).write.parquet(f"{folder}/in")
    out = BatchTable(f"{folder}/out", "event_id long, event_type string, user_id long")

    def batch(df: DataFrame, batch_id: int) -> None:
        for _ in range(2):
            out.put(df.select("event_id", "event_type", F.col("user_id").cast("long").alias("user_id")), batch_id)

    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out.read(spark).groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query(f"WITH {MESSAGES} SELECT id, payload, 'p' AS target FROM msg WHERE payload_type = 'T.view' AND NOT starts_with(payload, '[') UNION ALL SELECT id, payload, 'q' FROM msg WHERE payload_type = 'T.view' AND NOT starts_with(payload, '[')")
def stream_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through the exchange as a stream, with state, into folders by batch."""
    from ..streaming import jobs

    kind = "id string, payload_type string, payload string, routing_key string, correlation_id string, properties map<string,string>"
    folder = scratch(spark)
    ex.envelope(messages(spark, sf_dir).drop("ts")).where("payload_type = 'T.view' and not startswith(payload, '[')").repartition(2).write.parquet(f"{folder}/in")
    write = lambda name: lambda df, batch_id: publish_batch(df, f"{folder}/{name}", batch_id)
    exchange = ex.Exchange("s", [], [ex.Publisher(n, write(n), by_batch=True) for n in ("p", "q")])
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    jobs.stream_exchange(stream, exchange, lambda df, batch_id: None, f"{folder}/checkpoint", state=StateTable(f"{folder}/state", kind), by_batch=True).awaitTermination()
    read = lambda n: spark.read.schema(kind).parquet(f"{folder}/{n}").select("id", "payload", F.lit(n).alias("target"))
    return read("p").unionByName(read("q"))


@query("SELECT page_id, url AS uri, page_id % 3 <> 0 AS is_indexed FROM pages")
def response_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("uri"), F.when(F.col("page_id") % 3 != 0, F.lit(True)).alias("should_index"))
    return responses.response_documents(given)


@query("SELECT CASE WHEN event_id % 4 = 0 THEN sha256('{\"event_type\":\"' || event_type || '\",\"n\":' || event_id || '}') ELSE CAST(event_id AS VARCHAR) END AS id, event_type, '2024.01.15' AS index_date, '2024-01-15 12:00:00' AS updated FROM events WHERE event_type = 'error'")
def daily_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures written under their day, some without id, and read back."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    folder = scratch(spark)
    dt.write_daily_index(e.select(F.when(F.col("event_id") % 4 != 0, F.col("event_id").cast("string")).alias("id"), "event_type", F.col("event_id").alias("n")), folder, AS_OF)
    read = spark.read.schema("id string, event_type string, n long, updated timestamp, index_date string").parquet(folder)
    return read.select("id", "event_type", "index_date", stamp("updated").alias("updated"))


@query(f"""WITH {URIS}, {CONFIG} SELECT sha256(u.uri) AS request_id, u.uri, c.id AS config_id, c.document, c.continuation, c.download_content, c.provide_raw, c.should_index FROM uris u LEFT JOIN config c ON c.host = {HOST.format('u.uri')} AND NOT c.is_collector""")
def request_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = cfg.resolve_config(page_uris(spark, sf_dir).select("uri"), site_config(spark, sf_dir))
    return cfg.request_projection(resolved)


@query(f"""WITH {CONFIG} SELECT id, CASE WHEN length(host) % 3 = 0 THEN 'Table' ELSE document END AS document, CASE WHEN length(host) % 2 = 0 OR length(host) % 3 = 0 THEN CASE WHEN length(host) % 2 = 0 THEN '2023-01-01 00:00:00' ELSE '2024-01-15 12:00:00' END END AS created,
CASE WHEN length(host) % 2 = 0 AND length(host) % 3 = 0 THEN '2024-01-15 12:00:00' END AS updated FROM config WHERE NOT is_collector AND (length(host) % 2 = 0 OR length(host) % 3 = 0)""")
def config_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site configurations from a JSON file in the shared folder, into a table that has some of them."""
    sites = site_config(spark, sf_dir).where("not is_collector").withColumn("_n", F.length("host"))
    folder, then = scratch(spark), F.lit(None).cast("timestamp")
    lines = sites.where("_n % 3 = 0").drop("_n").withColumn("document", F.lit("Table"))
    lines.select(F.to_json(F.struct(*lines.columns)).alias("value")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("value")).coalesce(1).write.text(folder)
    stored = sites.where("_n % 2 = 0").drop("_n").withColumns({"created": F.lit(datetime(2023, 1, 1)).cast("timestamp"), "updated": then})
    return cfg.store_config(spark, folder, stored, AS_OF).select("id", "document", stamp("created").alias("created"), stamp("updated").alias("updated"))


@query(f"WITH {LINKS} SELECT base_uri, uri, 3 AS uri_type FROM found")
def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return lk.crawl_uri_events(parts.page_links(shred_html(pages, tags=["a"]), pages))


@query(f"WITH {MESSAGES} SELECT id, event_id % 2 = 1 AS is_new FROM msg WHERE given IS NOT NULL AND (event_id % 2 = 1 OR event_id % 4 <> 0)")
def outstanding_and_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a start works on: stored messages that aren't done, and new ones that aren't stored."""
    m = messages(spark, sf_dir).where("id is not null").select("id")
    n = F.col("id").cast("long")
    return ex.with_outstanding(m.where(n % 2 == 0), m.where(n % 4 == 0), m).select("id", "is_new")


@query(f"WITH {MESSAGES} SELECT id, payload || '!' AS payload, t AS target FROM msg, (VALUES ('p'), ('q')) v(t) WHERE payload_type = 'T.view' AND (t = 'p' OR contains(payload, 'h1.example')) AND NOT starts_with(payload, '[') UNION ALL SELECT id, payload || '!', 'p' FROM msg WHERE payload_type = 'T.view' AND starts_with(payload, '[') AND false")
def exchange_configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exchange from its description: one transformer by type, one publisher for all and one by url."""
    described = {
        "Name": "c",
        "DataIn": [{"Name": "events"}],
        "Transformers": [{"Name": "mark"}],
        "DataOut": [{"Name": "p"}, {"Name": "q"}],
        "Filters": [{"Kind": "type", "Match": "T.view", "Target": "mark"}, {"Kind": "all", "Target": "p"}, {"Kind": "url", "Match": "H1.example", "Target": "q"}],
        "MaxHops": 1,
    }
    mark = lambda m: m.withColumn("payload", F.concat("payload", F.lit("!")))
    exchange = ex.exchange_from_config(spark, described, {"mark": mark}, {"p": lambda df: None, "q": lambda df: None})
    m = messages(spark, sf_dir).where("not startswith(payload, '[')").drop("ts")
    return exchange.run(m).published.select("id", "payload", "target")


@query(f"WITH {EVENTS} SELECT DISTINCT lower(uri) AS uri FROM ev")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl events through the ingest stream, several batches: every uri is stored, whatever batch brings it."""
    from ..streaming import jobs

    folder = scratch(spark)
    events = crawl_events(spark, sf_dir)
    events.repartition(2).write.parquet(f"{folder}/in")
    frontier = BatchTable(f"{folder}/frontier", "id string, event_id long, uri string, base_uri string, uri_type int")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    none = spark.createDataFrame([], "uri string")
    jobs.ingest_into(stream, frontier, lambda: none, site_config(spark, sf_dir).limit(0), f"{folder}/checkpoint").awaitTermination()
    return frontier.read(spark).select("uri").distinct()


@query("SELECT 'h' || (user_id % 20) || '.example.com' AS host, count(*) AS n FROM events GROUP BY 1")
def stream_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts seen by a stream that keeps their state, in one batch."""
    from ..streaming import jobs

    folder = scratch(spark)
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("https://h"), (F.col("user_id") % 20).cast("string"), F.lit(".example.com/x")).alias("uri"), F.col("ts").cast("timestamp").alias("at"))
    e.coalesce(1).write.parquet(f"{folder}/in")
    seen = BatchTable(f"{folder}/seen", "host string, n long, state string")
    rows = jobs.active_hosts(spark.readStream.schema(e.schema).parquet(f"{folder}/in"))
    rows.writeStream.outputMode("append").foreachBatch(lambda df, batch_id: seen.put(df, batch_id)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return seen.read(spark).where("state = 'active'").select("host", "n")
