"""The URI frontier: ingest, existence, queries, passes, routing and politeness, over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sieve import may_match
from ..functions.urls import host, is_absolute
from ..schemas import URI_TYPES
from ..sources.staged import staged
from .config import create_requests, is_collectable, request_projection, resolve_config, should_skip, skip_rule

FOUND, ONETIME, PERIODIC, COLLECTOR = (URI_TYPES[t] for t in ("Found", "Onetime", "Periodic", "Collector"))


def row_id(*columns: str) -> Column:
    """An id that follows from the row alone, so that repeated runs agree."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def ingest_uris(events: DataFrame, uri: DataFrame, responses: DataFrame, config: DataFrame) -> DataFrame:
    """Every event (event_id, base_uri, uri, uri_type) with its outcome and, where it is new, its frontier row.

    A response with the very same uri makes it ``response_exists``; else, unless it is Onetime, a frontier row or an earlier stored event with the
    same uri in lower case makes it ``duplicate_uri``; else it is ``new_uri``, or ``skipped`` by its base's skip list (not for Onetime), stored in
    lower case with the base defaulting to it. event_id is the order of arrival. Of the frontier and the responses,
    however large, only rows that a bitmap of the events' uris lets pass are shuffled. Outcomes: count them with :func:`ingest_counts`.
    """
    e = events.select("event_id", "base_uri", "uri", "uri_type", F.lower("uri").alias("key"))
    answered = may_match(responses.select("uri"), F.col("uri"), e, F.col("uri")).distinct()
    known = may_match(uri.select(F.lower("uri").alias("key")), F.col("key"), e, F.col("key")).distinct()
    e = e.join(answered.withColumn("_answered", F.lit(True)), "uri", "left").join(known.withColumn("_known", F.lit(True)), "key", "left")
    open_ = F.col("_answered").isNull()
    earlier = Window.partitionBy("key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    # The first open event of a key is stored unless the frontier has it; Onetime events are stored always.
    stored_if = open_ & ((F.col("uri_type") == ONETIME) | F.col("_known").isNull())
    e = e.withColumn("_before", F.max(stored_if.cast("int")).over(earlier))
    base = F.coalesce("base_uri", "key")
    e = resolve_config(e.withColumn("base", base), config, "base")
    onetime = F.col("uri_type") == ONETIME
    skip = ~onetime & skip_rule(F.col("config"), F.col("key"))
    outcome = (
        F.when(~open_, "response_exists")
        .when(~onetime & (F.col("_known").isNotNull() | (F.coalesce("_before", F.lit(0)) == 1)), "duplicate_uri")
        .when(skip, "skipped")
        .otherwise("new_uri")
    )
    e = e.withColumn("outcome", outcome)
    stored = F.col("outcome").isin("new_uri", "skipped")
    skipped = F.col("outcome") == "skipped"
    return e.select(
        "event_id",
        "outcome",
        F.when(stored, F.col("key")).alias("uri"),
        F.when(stored, F.col("base")).alias("base_uri"),
        "uri_type",
        skipped.alias("is_skipped"),
        skipped.alias("is_completed"),
    )


def ingest_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def store_detected_urls(links: DataFrame, uri: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new rows, rejects): distinct links (base_uri, uri) whose exact uri isn't in the frontier, as Found; links without uri are rejects."""
    fresh = links.where("uri is not null").groupBy("uri").agg(F.min("base_uri").alias("base_uri")).join(uri.select("uri"), "uri", "left_anti")
    rows = fresh.select(row_id("uri").alias("id"), "uri", "base_uri", F.lit(FOUND).alias("uri_type"), F.lit(False).alias("is_completed"), F.lit(False).alias("is_skipped"))
    return rows, links.where("uri is null").withColumn("error", F.lit("link without uri"))


def existing(uris: DataFrame, uri: DataFrame) -> DataFrame:
    """The rows of ``uris`` whose uri the frontier has."""
    return uris.join(uri.select("uri"), "uri", "left_semi")


def guard_uris(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): frontier rows need an absolute uri."""
    ok = is_absolute("uri")
    return rows.where(ok), rows.where(~ok).withColumn("error", F.lit("not an absolute uri"))


def guard_work(items: DataFrame, uri: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejects): work items (uri_id) need their frontier row."""
    ids = uri.select(F.col("id").alias("uri_id"))
    return items.join(ids, "uri_id", "left_semi"), items.join(ids, "uri_id", "left_anti").withColumn("error", F.lit("unknown uri_id"))


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows.orderBy("id").limit(limit) if limit is not None else rows


def periodic(uri: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(uri.where((F.col("uri_type") == PERIODIC) & F.col("cron").isNotNull()), limit)


def collectors(uri: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(uri.where((F.col("uri_type") == COLLECTOR) & F.col("cron").isNotNull()), limit)


def new_collectors(uri: DataFrame, limit: int | None = 10) -> DataFrame:
    return _first(uri.where((F.col("uri_type") == COLLECTOR) & F.col("cron").isNull() & ~F.col("is_completed")), limit)


def found(uri: DataFrame, limit: int | None = 100) -> DataFrame:
    return _first(uri.where((F.col("uri_type") == FOUND) & ~F.col("is_completed")), limit)


def onetime(uri: DataFrame, limit: int | None = 100) -> DataFrame:
    return _first(uri.where((F.col("uri_type") == ONETIME) & ~F.col("is_completed")), limit)


def unscheduled(crawl_uri: DataFrame, limit: int | None = 200) -> DataFrame:
    return _first(crawl_uri.where("scheduled_at is null"), limit)


def process_found(uri: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, work, counts) of a pass over found rows (id, uri, base_uri, uri_type, is_completed, is_skipped).

    A skip-listed row is skipped and completed; a collectable one becomes a Collector, still open; any other gets a work item and is completed.
    """
    judged = is_collectable(should_skip(uri, config), config)
    keep = ~F.col("skip")
    kind = F.when(keep & F.col("collectable"), F.lit(COLLECTOR)).otherwise(F.col("uri_type"))
    work = keep & kind.isin(FOUND, ONETIME)
    judged = judged.withColumn("_work", work).withColumn("uri_type", kind)
    rows = judged.withColumn("is_skipped", F.col("skip") | F.col("is_skipped")).withColumn("is_completed", F.col("skip") | F.col("_work") | F.col("is_completed")).select(*uri.columns)
    items = judged.where("_work").select(row_id("id").alias("id"), F.col("id").alias("uri_id"), F.lit(None).cast("timestamp").alias("scheduled_at"), F.lit(None).cast("timestamp").alias("completed_at"))
    label = F.when(F.col("skip"), "skipped").when(F.col("_work"), "schedule_crawl").otherwise("collector")
    return rows, items, judged.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def process_onetime(uri: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, rows): a request for every open Onetime row with an absolute uri, which is then completed; others stay open."""
    ok = is_absolute("uri")
    requests = create_requests(uri.where(ok).select("id", "uri"), config)
    return requests, uri.withColumn("is_completed", F.col("is_completed") | ok)


def schedule_unscheduled(crawl_uri: DataFrame, uri: DataFrame, config: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(requests, stamped work items, orphans): open work items meet their frontier row and site; items without a row are errors."""
    open_ = crawl_uri.where("scheduled_at is null")
    rows = uri.select(F.col("id").alias("uri_id"), "uri")
    joined = open_.select("id", "uri_id").join(rows, "uri_id")
    requests = create_requests(joined, config)
    stamped = open_.join(rows.select("uri_id"), "uri_id", "left_semi").withColumn("scheduled_at", F.lit(as_of).cast("timestamp"))
    return requests, stamped.select(*crawl_uri.columns), open_.join(rows, "uri_id", "left_anti").withColumn("error", F.lit("unknown uri_id")).select(*crawl_uri.columns, "error")


def complete_crawls(crawl_uri: DataFrame, finished: DataFrame, as_of: datetime) -> DataFrame:
    """Work items with completed_at set to ``as_of`` for the ids in ``finished``."""
    done = finished.select("id").distinct().withColumn("_done", F.lit(True))
    return crawl_uri.join(done, "id", "left").withColumn("completed_at", F.when(F.col("_done"), F.lit(as_of).cast("timestamp")).otherwise(F.col("completed_at"))).select(*crawl_uri.columns)


def generate_paged_uris(spark: SparkSession, template: str, first: int = 1, last: int = 1742) -> DataFrame:
    """(page, uri) for a template with one ``%d``."""
    return spark.range(first, last + 1).select(F.col("id").alias("page"), F.format_string(template, F.col("id")).alias("uri"))


def paged_requests(spark: SparkSession, template: str, config: DataFrame, first: int = 1, last: int = 1742) -> DataFrame:
    """The requests of a template's pages with the definition of their site; fields are null where no configuration fits."""
    return request_projection(resolve_config(generate_paged_uris(spark, template, first, last), config))


def triage_collectors(uri: DataFrame, ignore: Sequence[str], once: Sequence[str]) -> DataFrame:
    """``uri`` with action: ``ignore`` (also skipped and completed) where a fragment of the first list is in it, else ``onetime`` by the second, else ``manual``."""
    hit = lambda items: F.exists(F.array(*[F.lit(x) for x in items]), lambda x: F.contains(F.col("uri"), x)) if items else F.lit(False)
    action = F.when(hit(ignore), "ignore").when(hit(once), "onetime").otherwise("manual")
    out = uri.withColumn("action", action)
    gone = F.col("action") == "ignore"
    return out.withColumn("is_skipped", F.col("is_skipped") | gone).withColumn("is_completed", F.col("is_completed") | gone)


def route_key(uri: Column, is_adhoc: Column) -> Column:
    """The queue of a request: its host, the whole text where that isn't a url, ``request*`` for one made by hand."""
    return F.when(is_adhoc, F.lit("request*")).when(host(uri) != "", host(uri)).otherwise(uri)


#: Seconds between requests to one host, from and up to; the hosts with limits of their own are configuration.
DEFAULT_LIMITS = (5, 15)
#: Parts of the queue for each shuffle partition.
PARTS = 16


def plan_fetch_times(requests: DataFrame, limits: DataFrame, last_request: DataFrame, now: datetime, seed: int = 0, default: tuple[int, int] = DEFAULT_LIMITS) -> DataFrame:
    """``requests`` (id, uri, enqueued_at) with host, delay and fetch_at: each waits its host's delay after the one before it.

    A delay is drawn from [min, max) seconds by a hash of seed and id (max <= min: min). The first request of a host waits from its last one
    (``last_request``: host, at), never before ``now``.

    Queues are cut by rank, whatever their times: all requests are dealt out in the order of host, time and id into ``PARTS`` parts for each shuffle partition and written once. A running sum is made within the
    parts, then over the parts of a host, and what is known of a host (limits, last request) comes by host and part, so that a hot host, or a burst at one instant, is many keys in every step.
    """
    spark = requests.sparkSession
    dealt = requests.withColumn("host", host("uri")).repartitionByRange(PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "enqueued_at", "id")
    rows = staged(dealt.withColumn("_part", F.spark_partition_id()))
    known = rows.select("host", "_part").distinct()
    known = known.join(limits.groupBy("host").agg(F.first("min_s").alias("_min"), F.first("max_s").alias("_max")), "host", "left").join(last_request.groupBy("host").agg(F.max("at").alias("_last")), "host", "left")
    known = known.withColumns({"_min": F.coalesce("_min", F.lit(default[0])), "_max": F.coalesce("_max", F.lit(default[1]))})
    width = F.greatest(F.col("_max") - F.col("_min"), F.lit(1))
    timed = rows.join(known, ["host", "_part"]).withColumn("delay", F.col("_min") + F.pmod(F.xxhash64(F.lit(seed), "id"), width.cast("long")).cast("int"))
    inside = Window.partitionBy("host", "_part").orderBy("enqueued_at", "id")
    timed = timed.withColumn("_inner", F.sum("delay").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_k", F.row_number().over(inside))
    sums = timed.groupBy("host", "_part").agg(F.sum("delay").alias("_sum"), F.min_by("delay", "_k").alias("_first"), F.first("_last").alias("_last"))
    over_parts = Window.partitionBy("host").orderBy("_part")
    ago = (F.lit(now).cast("timestamp").cast("double") - F.col("_last").cast("double")).cast("int")
    head = F.first("_first").over(over_parts.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    offsets = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(over_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_head": head})
    offsets = offsets.select("host", "_part", (F.col("_before") - F.greatest(F.lit(0), F.least("_head", F.coalesce(ago, F.col("_head"))))).alias("_offset"))
    planned = timed.join(offsets, ["host", "_part"]).withColumn("_wait", F.col("_inner") + F.col("_offset"))
    at = F.lit(now).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_wait").cast("decimal(18,6)"))
    return planned.select(*requests.columns, "host", "delay", at.alias("fetch_at"))


def last_requests(events: DataFrame, as_of: datetime, ttl_seconds: int = 15) -> DataFrame:
    """(host, at): each host's latest request, unless it is older than the time to live."""
    latest = events.groupBy(host("uri").alias("host")).agg(F.max("at").alias("at"))
    return latest.where(F.col("at") > F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl_seconds).cast("decimal(18,6)")))


def crawl_status(events: DataFrame) -> DataFrame:
    """(crawl_id, status, at): the latest event of each crawl."""
    return events.groupBy("crawl_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.max("at").alias("at"))
