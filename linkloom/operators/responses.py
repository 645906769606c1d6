"""Crawl responses as stored, search, index and failure documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import brief_summary, index_stamp, iso_millis


def response_documents(responses: DataFrame) -> DataFrame:
    """The full document of each response: everything, and is_indexed from should_index."""
    return responses.withColumn("is_indexed", F.coalesce("should_index", F.lit(False))).drop("should_index")


def _texts(parts: DataFrame, suffix: str = "") -> DataFrame:
    """(response_id, owner_id, content): trimmed, non-empty texts of a part's descendants in order, one per line."""
    text = F.trim(F.coalesce("text", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.when(text != "", F.struct("ord", text.alias("t"))))), lambda x: x["t"])
    return parts.where("part_type = 'Text'").groupBy("response_id", "owner_id").agg(F.array_join(F.transform(ordered, lambda t: F.concat(t, F.lit("\n"))), "").alias("content"))


def search_documents(responses: DataFrame, parts: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of responses (id, uri, correlation_id, crawler_id, timestamp, should_index) and their flat parts.

    ``parts``: response_id, part_id, owner_id, ord, part_type, name, text, title. owner_id is the article that a part stands in (null at the root). Only responses to be
    indexed have a document: from the first article, else from all texts. Title and heading default to empty; an article without text is a reject.
    """
    wanted = responses.where("should_index")
    first = Window.partitionBy("response_id").orderBy("ord")
    articles = parts.where("part_type = 'Article'").withColumn("_k", F.row_number().over(first)).where("_k = 1").select("response_id", F.col("part_id").alias("owner_id"), F.coalesce("title", F.lit("")).alias("title"))
    heads = parts.where("name = 'Heading'").groupBy("response_id", "owner_id").agg(F.min_by(F.coalesce("text", F.lit("")), "ord").alias("heading"))
    by_article = articles.join(_texts(parts.where("coalesce(name, '') != 'Heading'")), ["response_id", "owner_id"], "left").join(heads, ["response_id", "owner_id"], "left").drop("owner_id").withColumn("has_article", F.lit(True))
    plain = _texts(parts.withColumn("owner_id", F.lit(None).cast("string"))).select("response_id", F.col("content").alias("plain"))
    out = wanted.join(by_article, wanted["id"] == by_article["response_id"], "left").drop("response_id").join(plain, wanted["id"] == plain["response_id"], "left").drop("response_id")
    empty = F.lit("")
    out = out.withColumn("content", F.when(F.col("has_article"), F.coalesce("content", empty)).otherwise(F.coalesce("plain", empty)))
    bad = F.coalesce("has_article", F.lit(False)) & (F.col("content") == "")
    docs = out.where(~bad).select(
        "id",
        F.coalesce("correlation_id", empty).alias("correlation_id"),
        F.coalesce("crawler_id", empty).alias("crawler_id"),
        F.coalesce("title", empty).alias("title"),
        F.coalesce("heading", empty).alias("heading"),
        "content",
        "uri",
        iso_millis(F.coalesce("timestamp", F.lit(as_of).cast("timestamp"))).alias("timestamp"),
    )
    return docs, out.where(bad).select("id", "uri", F.lit("article without content").alias("error"))


def index_documents(responses: DataFrame, parts: DataFrame, as_of, with_links: bool = False) -> DataFrame:
    """Index documents: the first article's title, its texts and table summaries each followed by ``. \\n``, its links where wanted; empty without article."""
    first = Window.partitionBy("response_id").orderBy("ord")
    articles = parts.where("part_type = 'Article'").withColumn("_k", F.row_number().over(first)).where("_k = 1").select("response_id", F.col("part_id").alias("owner_id"), "title", F.col("text").alias("stamp"))
    inside = parts.join(articles.select("response_id", "owner_id"), ["response_id", "owner_id"], "left_semi")

    def joined(kind: str, value, name: str) -> DataFrame:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", value.alias("t")))), lambda x: F.concat(x["t"], F.lit(". \n")))
        return inside.where(F.col("part_type") == kind).groupBy("response_id").agg(F.array_join(ordered, "").alias(name))

    text, empty = F.coalesce("text", F.lit("")), F.lit("")
    out = responses.withColumnRenamed("id", "response_id").join(articles, "response_id", "left").join(joined("Text", text, "said"), "response_id", "left").join(joined("Table", brief_summary(text), "tables"), "response_id", "left")
    link = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("text", empty).alias("name"), F.coalesce("uri", empty).alias("uri")))), lambda x: F.struct(x["name"].alias("name"), x["uri"].alias("uri")))
    if with_links:
        out = out.join(inside.where("part_type in ('Link', 'File')").groupBy("response_id").agg(link.alias("links")), "response_id", "left")
    links = F.coalesce("links", F.array().cast("array<struct<name:string,uri:string>>")) if with_links else F.array().cast("array<struct<name:string,uri:string>>")
    stamp = F.when(F.coalesce("stamp", empty) == "", index_stamp(F.lit(as_of).cast("timestamp"))).otherwise(F.col("stamp"))
    return out.select(F.col("response_id").alias("id"), stamp.alias("timestamp"), "correlation_id", "crawler_id", F.coalesce("title", empty).alias("title"), F.coalesce("said", empty).alias("text"), F.coalesce("tables", empty).alias("tables"), links.alias("links"))


def failure_documents(failures: DataFrame) -> DataFrame:
    """(id, crawler_id, text, error_uri): message and stack of failed requests (id, crawler_id, uri, message, stack)."""
    return failures.select("id", "crawler_id", F.concat(F.coalesce("message", F.lit("")), F.lit("\n"), F.coalesce("stack", F.lit(""))).alias("text"), F.col("uri").alias("error_uri"))
