"""Document tables: filtered reads, upserts, deletes, search bodies, daily indexes, message envelopes, polymorphic JSON."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import compile_filters
from ..functions.text import match_score, matches
from .staged import buckets, staged

DEFAULT_LIMIT = 100


def read_documents(df: DataFrame, filters: Sequence[dict] = (), limit: int | None = DEFAULT_LIMIT, skip: int = 0, order: str = "id") -> DataFrame:
    """The rows that pass the filters, from ``skip``, ``limit`` of them (None: all), in the order of a column so that pages don't overlap."""
    rows = df.where(compile_filters(filters))
    if limit is None and not skip:
        return rows
    rows = rows.orderBy(order).offset(skip)
    return rows if limit is None else rows.limit(limit)


def upsert(target: DataFrame, updates: DataFrame, as_of, key: str = "id", order: str | None = None) -> DataFrame:
    """``target`` with ``updates``: a known key is replaced and gets ``updated``, an unknown one inserted with ``created``; a null key gets one.

    Of several updates of a key the last by ``order`` (or by all columns) counts. Columns created and updated are managed here; others are the target's.
    """
    now = F.lit(as_of).cast("timestamp")
    columns = [c for c in target.columns if c not in ("created", "updated")]
    content = F.sha2(F.to_json(F.struct(*columns)), 256)
    fresh = updates.withColumn(key, F.coalesce(F.col(key).cast("string"), content) if dict(target.dtypes)[key] == "string" else F.coalesce(F.col(key), F.xxhash64(content)))
    last = Window.partitionBy(key).orderBy(*([F.col(order).desc()] if order else []), content.desc())
    fresh = fresh.withColumn("_k", F.row_number().over(last)).where("_k = 1")
    known = target.select(key, F.col("created").alias("_created"))
    new = fresh.join(known, key, "left").select(*columns, F.when(F.col("_created").isNull(), now).otherwise(F.col("_created")).alias("created"), F.when(F.col("_created").isNotNull(), now).alias("updated"))
    kept = target.join(fresh.select(key), key, "left_anti").select(*columns, "created", "updated")
    return kept.unionByName(new)


def write_snapshot(df: DataFrame, folder: str) -> DataFrame:
    """Write a table's next version beside those before, never over one that is being read, and read it back."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def delete_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def delete_where(df: DataFrame, filters: Sequence[dict]) -> DataFrame:
    return df.where(~compile_filters(filters))


def parse_search_hits(bodies: DataFrame, schema: str, column: str = "body") -> DataFrame:
    """The decoded ``hits.hits[]._source`` of search results (JSON); hits that don't decode are left out, bodies without hits give none."""
    shape = "struct<hits:struct<hits:array<struct<_id:string,_source:string>>>>"
    hits = bodies.select(F.explode(F.from_json(column, shape)["hits"]["hits"]).alias("h"))
    source = F.from_json("h._source", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = hits.select(F.col("h._id").alias("_id"), source.alias("doc"))
    fields = bodies.sparkSession.createDataFrame([], schema).columns
    some = F.coalesce(*[F.col(f"doc.{c}").cast("string") for c in fields])
    return rows.where(some.isNotNull()).select("_id", *[F.col(f"doc.{c}").alias(c) for c in fields])


def match_text(df: DataFrame, column: str, query: str) -> DataFrame:
    """Rows whose text holds any word of the query, with score, the number of its distinct words."""
    return df.where(matches(F.col(column), query)).withColumn("score", match_score(F.col(column), query))


def write_daily_index(df: DataFrame, folder: str, as_of, id_column: str = "id") -> None:
    """Append documents under their index date; an empty id becomes a digest, updated is set."""
    dated = daily_index(df, as_of, id_column)
    dated.write.mode("append").partitionBy("index_date").parquet(folder)


def daily_index(df: DataFrame, as_of, id_column: str = "id") -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    content = F.sha2(F.to_json(F.struct(*[c for c in df.columns if c != id_column])), 256)
    given = F.when(F.coalesce(F.col(id_column), F.lit("")) != "", F.col(id_column))
    return df.withColumn(id_column, F.coalesce(given, content)).withColumn("updated", now).withColumn("index_date", F.date_format(now, "yyyy.MM.dd"))


def to_messages(df: DataFrame, payload_type: str, routing_key: str | None = None, id_column: str = "id") -> DataFrame:
    """Rows as messages: payload is the row in JSON; correlation_id defaults to the id, routing_key to the given one."""
    has = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    id_ = F.col(id_column).cast("string")
    return df.select(
        id_.alias("id"),
        F.lit(payload_type).alias("payload_type"),
        F.to_json(F.struct(*df.columns)).alias("payload"),
        F.coalesce(has("routing_key"), F.lit(routing_key)).alias("routing_key"),
        F.coalesce(has("correlation_id"), id_).alias("correlation_id"),
        F.create_map().cast("map<string,string>").alias("properties"),
    )


def option_value(json: Column, name: str) -> Column:
    """A field of a JSON object that may be missing, a plain value or a list of at most one."""
    plain = F.get_json_object(json, f"$.{name}")
    listed = F.get_json_object(json, f"$.{name}[0]")
    return F.when(F.ltrim(plain).startswith("["), listed).otherwise(plain)


PART_NAMES = {"1": "Text", "2": "Link", "3": "File", "4": "Table", "5": "Row", "6": "Article", "7": "AutoDetect", "8": "Stream", "9": "Form", "10": "Meta"}


def decode_parts(docs: DataFrame, column: str, depth: int | None = None) -> DataFrame:
    """(id, part_id, parent_id, depth, part_type, name, base_uri, text, uri, selector) of nested part definitions in JSON, level by level.

    Every level is written to the shared folder, read field by field once, and the next one is read from it, until no part is nested any deeper; with ``depth``, only so many levels
    are decoded. Values may be plain or lists of one; the type is DocPartType or docPartType, a number or a name. part_id is the path of positions.
    """
    names = F.create_map(*[F.lit(x) for pair in PART_NAMES.items() for x in pair])
    fields = {"DocPartType": "_kind", "docPartType": "_kind2", "Name": "name", "BaseUri": "base_uri", "Text": "text", "Uri": "uri", "Selector": "_selector"}

    def read(parts: DataFrame) -> DataFrame:
        """id, part_id, parent_id, the fields and subs of parts in ``j``."""
        told = parts.select("id", "part_id", "parent_id", "j", F.json_tuple("j", *fields, "SubParts").alias(*fields.values(), "subs"))
        single = [F.when(F.ltrim(a).startswith("["), F.get_json_object("j", f"$.{n}[0]")).otherwise(F.col(a)).alias(a) for n, a in fields.items()]
        return told.select("id", "part_id", "parent_id", "subs", *single).withColumn("selector", option_value(F.col("_selector"), "Xpath")).drop("_selector")

    level = docs.select("id", F.lit("0").alias("part_id"), F.lit(None).cast("string").alias("parent_id"), F.col(column).alias("j")).where("j is not null")
    many = buckets(docs.sparkSession)
    if len(docs.inputFiles() or range(many)) < many:  # small files hold many rows, and reading them takes far longer than moving them
        level = level.repartition(many)
    out, d = None, 0
    while depth is None or d < depth:
        level = staged(read(level))
        if out is not None and level.isEmpty():
            break
        kind = F.coalesce("_kind", "_kind2")
        rows = level.select("id", "part_id", "parent_id", F.lit(d).alias("depth"), F.coalesce(F.try_element_at(names, kind), kind).alias("part_type"), "name", "base_uri", "text", "uri", "selector")
        out = rows if out is None else out.unionByName(rows)
        subs = F.coalesce(F.from_json("subs", "array<string>"), F.array().cast("array<string>"))
        nested = F.transform(subs, lambda s: F.when(F.ltrim(s).startswith("["), F.from_json(s, "array<string>")).otherwise(F.array(s)))
        level = level.where("subs is not null").select("id", F.col("part_id").alias("parent_id"), F.posexplode(F.flatten(nested)).alias("_pos", "j")).select("id", F.concat_ws(".", "parent_id", F.col("_pos").cast("string")).alias("part_id"), "parent_id", "j")
        d += 1
    return out
