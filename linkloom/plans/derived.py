"""Inputs of the registered queries, derived from the given tables, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import host


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a frontier row: the kinds of uri and the flags go by its id."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    id_ = F.col("page_id")
    return p.select(
        F.lpad(id_.cast("string"), 12, "0").alias("id"),
        F.col("url").alias("uri"),
        F.concat(F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1), F.lit("/")).alias("base_uri"),
        (id_ % 5 + 1).cast("int").alias("uri_type"),
        F.when(id_ % 3 == 0, F.lit("0/15 30 6 * * ?")).alias("cron"),
        (id_ % 4 == 1).alias("is_completed"),
        F.lit(False).alias("is_skipped"),
    )


URIS = """uris AS (SELECT lpad(CAST(page_id AS VARCHAR), 12, '0') AS id, url AS uri, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' AS base_uri,
  CAST(page_id % 5 + 1 AS INTEGER) AS uri_type, CASE WHEN page_id % 3 = 0 THEN '0/15 30 6 * * ?' END AS cron, page_id % 4 = 1 AS is_completed, false AS is_skipped, page_id
  FROM pages WHERE url IS NOT NULL)"""


def site_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration for three of four hosts, every fifth of them with one for collectors; lists and patterns go by the host's length."""
    hosts = table(spark, sf_dir, "pages").select(host("url").alias("host")).where("host != ''").distinct().withColumn("n", F.length("host"))
    rows = hosts.where("n % 4 != 0").select(
        F.concat(F.lit("c-"), "host").alias("id"),
        "host",
        F.lit("*").alias("uri"),
        F.lit(False).alias("is_collector"),
        F.lit("Article").alias("document"),
        F.when(F.col("n") % 2 == 0, F.lit("[0-9]$")).otherwise(F.lit("html$")).alias("collectable_pattern"),
        F.when(F.col("n") % 3 == 1, F.array(F.lit("UTM_source"))).when(F.col("n") % 3 == 2, F.array(F.lit("#top"), F.lit("page="))).alias("url_skip_list"),
        (F.col("n") % 6 + 1).cast("int").alias("continuation"),
        (F.col("n") % 2 == 0).alias("download_content"),
        (F.col("n") % 3 == 0).alias("provide_raw"),
        F.lit(True).alias("should_index"),
    )
    collect = hosts.where("n % 5 = 0").select(F.concat(F.lit("k-"), "host").alias("id"), "host", F.lit("*").alias("uri"), F.lit(True).alias("is_collector"), F.lit("Link").alias("document"))
    return rows.unionByName(collect, allowMissingColumns=True)


HOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1))"
CONFIG = f"""hosts AS (SELECT DISTINCT {HOST.format("url")} AS host FROM pages WHERE url IS NOT NULL),
config AS (SELECT 'c-' || host AS id, host, false AS is_collector, 'Article' AS document, CASE WHEN length(host) % 2 = 0 THEN '[0-9]$' ELSE 'html$' END AS collectable_pattern,
  CASE WHEN length(host) % 3 = 1 THEN ['UTM_source'] WHEN length(host) % 3 = 2 THEN ['#top', 'page='] END AS url_skip_list, CAST(length(host) % 6 + 1 AS INTEGER) AS continuation,
  length(host) % 2 = 0 AS download_content, length(host) % 3 = 0 AS provide_raw, true AS should_index FROM hosts WHERE host <> '' AND length(host) % 4 <> 0
  UNION ALL SELECT 'k-' || host, host, true, 'Link', NULL, NULL, NULL, NULL, NULL, NULL FROM hosts WHERE host <> '' AND length(host) % 5 = 0)"""
SKIP = "CASE WHEN c.id IS NULL THEN false WHEN c.url_skip_list IS NULL THEN true ELSE len(list_filter(c.url_skip_list, lambda x: contains(lower({0}), lower(x)))) > 0 END"


def crawl_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl events from page urls and events: some in capitals, some twice, some with a base, in the order of event_id."""
    p = table(spark, sf_dir, "pages").select("page_id", "url").where("url is not null")
    n = F.col("page_id")
    first = p.select((n * 2).alias("event_id"), F.when(n % 2 == 0, F.regexp_extract("url", r"^([a-z]+://[^/?#]*)", 1)).alias("base_uri"), F.when(n % 7 == 0, F.upper("url")).otherwise(F.col("url")).alias("uri"), (n % 3 + 1).cast("int").alias("uri_type"))
    again = p.where(n % 3 == 0).select((n * 2 + 1).alias("event_id"), F.lit(None).cast("string").alias("base_uri"), F.col("url").alias("uri"), F.lit(3).alias("uri_type"))
    return first.unionByName(again)


EVENTS = """ev AS (SELECT page_id * 2 AS event_id, CASE WHEN page_id % 2 = 0 THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) END AS base_uri, CASE WHEN page_id % 7 = 0 THEN upper(url) ELSE url END AS uri,
  CAST(page_id % 3 + 1 AS INTEGER) AS uri_type FROM pages WHERE url IS NOT NULL
  UNION ALL SELECT page_id * 2 + 1, NULL, url, 3 FROM pages WHERE url IS NOT NULL AND page_id % 3 = 0)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: the type is both routing key and payload type; every tenth payload is a list, every sixth has no id."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    payload = F.when(n % 10 == 0, F.concat(F.lit('["a'), n.cast("string"), F.lit('","b"]'))).otherwise(F.concat(F.lit('{"uri":"https://h'), F.col("user_id").cast("string"), F.lit('.example.com/'), "event_type", F.lit('"}')))
    return e.select(
        F.when(n % 6 != 0, n.cast("string")).alias("id"),
        F.concat(F.lit("T."), "event_type").alias("payload_type"),
        payload.alias("payload"),
        F.col("event_type").alias("routing_key"),
        F.when(n % 4 == 0, F.col("user_id").cast("string")).alias("correlation_id"),
        F.create_map(F.lit("n"), n.cast("string")).alias("properties"),
        "ts",
    )


MESSAGES = """plain_msg AS (SELECT CASE WHEN event_id % 6 <> 0 THEN CAST(event_id AS VARCHAR) END AS given, 'T.' || event_type AS payload_type,
  CASE WHEN event_id % 10 = 0 THEN '["a' || event_id || '","b"]' ELSE '{"uri":"https://h' || user_id || '.example.com/' || event_type || '"}' END AS payload, event_type AS routing_key,
  CASE WHEN event_id % 4 = 0 THEN CAST(user_id AS VARCHAR) END AS correlation_id, ts, event_id, user_id FROM events),
digest_msg AS (SELECT *, sha256(payload_type || chr(31) || payload || chr(31) || routing_key || chr(31) || coalesce(correlation_id, chr(0))) AS digest FROM plain_msg),
place_msg AS (SELECT *, row_number() OVER (PARTITION BY given IS NULL, digest ORDER BY CAST(event_id AS VARCHAR)) AS place FROM digest_msg),
msg AS (SELECT *, coalesce(given, digest || CASE WHEN place = 1 THEN '' ELSE '-row-' || place END) AS id FROM place_msg)"""


def built_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer with orders: a table of orders with headers, links, images with and without source, files, empty rows and tables in cells; every sixth page has no title."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    key = k.cast("string")
    third = F.when(k % 4 == 0, F.concat(F.lit("<table><tr><td>in "), key, F.lit("</td></tr></table>"))).otherwise(F.concat(F.lit("plain "), key))
    image = F.concat(F.lit('<img src="/i/'), key, F.lit('.png">'))
    last = F.when(k % 3 == 0, F.concat(image, F.lit('<a href="/f/'), key, F.lit('.pdf">file '), key, F.lit("</a>"))).when(k % 3 == 1, F.lit("<img>")).otherwise(image)
    cells = F.concat(F.lit("<td>"), key, F.lit('</td><td><a href="/s/'), "o_orderstatus", F.lit('">'), "o_orderstatus", F.lit("</a></td><td>"), third, F.lit("</td><td>"), last, F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), F.when(k % 7 == 0, F.lit("")).otherwise(cells), F.lit("</tr>"))
    rows = table(spark, sf_dir, "orders").groupBy(c.cast("long").alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), row.alias("row")))), lambda x: x["row"]), "").alias("rows"))
    title = F.when(F.col("page_id") % 6 == 0, F.lit("")).otherwise(F.concat(F.lit("<title>Customer "), F.col("page_id").cast("string"), F.lit("</title>")))
    head = "</head><body><table><tr><th>Key</th><th>Status</th><th>Note</th><th>Files</th></tr>"
    return rows.select("page_id", F.concat(F.lit("https://c"), F.col("page_id").cast("string"), F.lit(".example.org/orders")).alias("url"), F.concat(F.lit("<html><head>"), title, F.lit(head), "rows", F.lit("</table></body></html>")).alias("html"))


BUILT = """ord AS (SELECT CAST(o_custkey AS BIGINT) AS page_id, o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS st, 'https://c' || o_custkey || '.example.org' AS site, o_orderkey % 7 = 0 AS bare,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS row_no FROM orders),
full_ord AS (SELECT * FROM ord WHERE NOT bare),
inner_tables AS (SELECT page_id, key, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS table_no FROM full_ord WHERE k % 4 = 0),
cells AS (
  SELECT page_id, 0 AS table_no, -1 AS row_no, c.col_no, true AS is_header, 'Text' AS part_type, c.name || chr(10) AS text, CAST(NULL AS VARCHAR) AS uri FROM (SELECT DISTINCT page_id FROM ord) p, (VALUES (0, 'Key'), (1, 'Status'), (2, 'Note'), (3, 'Files')) c(col_no, name)
  UNION ALL SELECT page_id, 0, row_no, 0, false, NULL, NULL, NULL FROM ord WHERE bare
  UNION ALL SELECT page_id, 0, row_no, 0, false, 'Text', key || chr(10), NULL FROM full_ord
  UNION ALL SELECT page_id, 0, row_no, 1, false, 'Link', st || chr(10), site || '/s/' || st FROM full_ord
  UNION ALL SELECT page_id, 0, row_no, 2, false, 'Text', CASE WHEN k % 4 = 0 THEN 'in ' ELSE 'plain ' END || key || chr(10), NULL FROM full_ord
  UNION ALL SELECT page_id, 0, row_no, 3, false, CASE WHEN k % 3 = 0 THEN 'Article' ELSE 'File' END, CASE WHEN k % 3 = 0 THEN 'file ' || key ELSE '' END || chr(10), CASE WHEN k % 3 <> 1 THEN site || '/i/' || key || '.png' END FROM full_ord
  UNION ALL SELECT page_id, table_no, 0, 0, false, 'Text', 'in ' || key || chr(10), NULL FROM inner_tables),
texts AS (SELECT page_id, table_no, string_agg(CASE WHEN is_header THEN rtrim(text, chr(10)) || '. ' || chr(10) ELSE coalesce(rtrim(text, chr(10)), '') || chr(10) END, '' ORDER BY row_no, col_no) AS text FROM cells GROUP BY ALL),
anchors AS (SELECT page_id, min(k * 10 + 1) AS pos, st AS text, site || '/s/' || st AS uri FROM full_ord GROUP BY ALL UNION ALL SELECT page_id, k * 10 + 3, 'file ' || key, site || '/f/' || key || '.pdf' FROM full_ord WHERE k % 3 = 0),
images AS (SELECT page_id, k AS pos, site || '/i/' || key || '.png' AS uri FROM full_ord WHERE k % 3 <> 1 UNION ALL SELECT page_id, min(k), NULL FROM full_ord WHERE k % 3 = 1 GROUP BY page_id)"""
