"""Link continuation: which links of a response become crawl events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import domain_key, host
from ..schemas import URI_TYPES


def continuation_links(links: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(page_id, base_uri, uri) of links, and of file links where those are given."""
    out = links.select("page_id", "base_uri", "uri")
    return out.unionByName(files.select("page_id", "base_uri", "uri")) if files is not None else out


def within_domain(links: DataFrame, uri: str = "uri", base: str = "base_uri") -> DataFrame:
    """Links whose host is the base's, ``www.`` and case aside; links without uri go."""
    return links.where((F.col(uri).isNotNull()) & (domain_key(uri) == domain_key(base)))


def apply_continuation(responses: DataFrame, links: DataFrame, custom: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of responses (page_id, uri, strategy) and their links (page_id, uri).

    All, DomainOnly and Onetime publish links as Onetime, TrackLinksOnly as Found; None, null or an unknown strategy publishes nothing. Custom is
    looked up in ``custom`` (match, strategy) by exact uri, then by host; where it isn't found the response is a reject with an error.
    """
    spark = responses.sparkSession
    custom = custom if custom is not None else spark.createDataFrame([], "match string, strategy string")
    r = responses.select("page_id", F.col("uri").alias("base_uri"), "strategy")
    by_uri = custom.select(F.col("match").alias("base_uri"), F.col("strategy").alias("_u")).dropDuplicates(["base_uri"])
    by_host = custom.select(F.col("match").alias("_host"), F.col("strategy").alias("_h")).dropDuplicates(["_host"])
    r = r.withColumn("_host", host("base_uri")).join(by_uri, "base_uri", "left").join(by_host, "_host", "left")
    r = r.withColumn("action", F.when(F.col("strategy") == "Custom", F.coalesce("_u", "_h")).otherwise(F.col("strategy")))
    rejects = r.where("strategy = 'Custom' and action is null").select("page_id", F.col("base_uri").alias("uri"), F.concat(F.lit("no custom continuation for "), F.col("base_uri")).alias("error"))
    act = r.where(F.col("action").isin("All", "DomainOnly", "Onetime", "TrackLinksOnly")).select("page_id", "base_uri", "action")
    out = links.select("page_id", "uri").join(act, "page_id").where((F.col("action") != "DomainOnly") | (F.col("uri").isNotNull() & (domain_key("uri") == domain_key("base_uri"))))
    kind = F.when(F.col("action") == "TrackLinksOnly", URI_TYPES["Found"]).otherwise(URI_TYPES["Onetime"])
    return out.select("base_uri", "uri", kind.alias("uri_type")), rejects


def crawl_uri_events(links: DataFrame, uri_type: str = "Found") -> DataFrame:
    """One event (base_uri, uri, uri_type) per link."""
    return links.select("base_uri", "uri", F.lit(URI_TYPES[uri_type]).alias("uri_type"))
