"""Site configuration: look-up, requests, skip and collection rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import contains_any
from ..functions.urls import host, without_query
from ..schemas import CONFIG, CONTINUATION
from ..sources.documents import upsert

GENERIC = {"document": "AutoDetect", "continuation": CONTINUATION["All"], "should_index": True, "provide_raw": True, "download_content": False}


def load_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of site configurations; a file that doesn't fit the schema stops the load."""
    return spark.read.schema(CONFIG).option("multiLine", True).option("mode", "FAILFAST").json(path)


def store_config(spark: SparkSession, path: str, stored: DataFrame, as_of) -> DataFrame:
    """``stored``, a table of configurations with created and updated, with those of a file inserted or in place of the ones with their id."""
    return upsert(stored, load_config(spark, path), as_of)


def resolve_config(uris: DataFrame, config: DataFrame, uri: str = "uri", collector: bool = False) -> DataFrame:
    """``uris`` with the struct ``config`` of the entry that fits: the uri's host, its address without query or ``*``, and the collector flag.

    An exact address goes before ``*``, then the lowest id; null where none fits. Every row of ``uris`` stays one row: the configuration
    is reduced to one entry per key before it is joined, and Spark broadcasts it as long as it is small.
    """
    keyed = uris.withColumn("_host", host(uri)).withColumn("_plain", without_query(uri))
    rows = config.where(F.coalesce("is_collector", F.lit(False)) == F.lit(collector)).withColumn("_host", F.lower("host"))
    exact = rows.where("uri != '*'").groupBy("_host", F.col("uri").alias("_plain")).agg(F.min_by(F.struct(*config.columns), "id").alias("_exact"))
    any_ = rows.where("uri = '*'").groupBy("_host").agg(F.min_by(F.struct(*config.columns), "id").alias("_any"))
    out = keyed.join(exact, ["_host", "_plain"], "left").join(any_, "_host", "left")
    return out.select(*uris.columns, F.coalesce("_exact", "_any").alias("config"))


def create_requests(uris: DataFrame, config: DataFrame, uri: str = "uri") -> DataFrame:
    """A request per uri: its site's definition, or the generic one (auto-detect, all links, indexed, raw) without any."""
    found = resolve_config(uris, config, uri)
    c = F.col("config")
    return found.select(
        *uris.columns,
        c["id"].alias("config_id"),
        F.coalesce(c["document"], F.lit(GENERIC["document"])).alias("document"),
        F.when(c.isNull(), F.lit(GENERIC["continuation"])).otherwise(F.coalesce(c["continuation"], F.lit(CONTINUATION["None"]))).alias("continuation"),
        F.when(c.isNull(), F.lit(True)).otherwise(F.coalesce(c["should_index"], F.lit(False))).alias("should_index"),
        F.when(c.isNull(), F.lit(True)).otherwise(F.coalesce(c["provide_raw"], F.lit(False))).alias("provide_raw"),
        F.coalesce(c["download_content"], F.lit(False)).alias("download_content"),
    )


def create_collector_requests(uris: DataFrame, config: DataFrame, uri: str = "uri") -> DataFrame:
    """A request per collector uri: links are only tracked, whatever its site says; auto-detect without a definition."""
    found = resolve_config(uris, config, uri, collector=True)
    return found.select(*uris.columns, F.col("config.id").alias("config_id"), F.coalesce("config.document", F.lit(GENERIC["document"])).alias("document"), F.lit(CONTINUATION["TrackLinksOnly"]).alias("continuation"))


def request_projection(uris: DataFrame, uri: str = "uri") -> DataFrame:
    """Requests from uris that already carry their ``config``: id, uri and the definition's fields."""
    c = F.col("config")
    return uris.select(F.sha2(F.col(uri), 256).alias("request_id"), F.col(uri).alias("uri"), c["id"].alias("config_id"), c["document"].alias("document"), c["continuation"].alias("continuation"), c["download_content"].alias("download_content"), c["provide_raw"].alias("provide_raw"), c["should_index"].alias("should_index"))


def skip_rule(config: Column, uri: Column) -> Column:
    """Skip where the list has an item that the uri contains, case aside, and where the list is null; keep where there is no configuration."""
    return F.when(config.isNull(), F.lit(False)).otherwise(F.coalesce(contains_any(F.coalesce(uri, F.lit("")), config["url_skip_list"]), F.lit(True)))


def should_skip(uris: DataFrame, config: DataFrame) -> DataFrame:
    """``uris`` (uri, base_uri, ...) with skip: the rule of the base's site; a null base keeps."""
    found = resolve_config(uris, config, "base_uri")
    return found.select(*uris.columns, skip_rule(F.col("config"), F.col("uri")).alias("skip"))


def is_collectable(uris: DataFrame, config: DataFrame) -> DataFrame:
    """``uris`` with collectable: the pattern of the uri's site is found in the uri; false without configuration or pattern."""
    found = resolve_config(uris, config, "uri")
    return found.select(*uris.columns, F.coalesce(F.regexp_like("uri", F.col("config.collectable_pattern")), F.lit(False)).alias("collectable"))
