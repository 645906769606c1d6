"""CSV lines as string maps, and tables as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUTSIDE_QUOTES = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'
GUID = r"^\{?[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\}?$"


def _trimmed(values: Column) -> Column:
    return F.transform(values, lambda x: F.trim(x))


def read_csv_maps(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(good: file, line_no, id, data map<string,string>; bad: file, line_no, line, error) of CSV files with a header each.

    The header is a file's first line, split at every comma; other lines are split at commas outside of double quotes, quotes stay, all is
    trimmed. A line with another number of values, or a header with a name twice, is bad. data gets ``Id`` (a digest of file and line) where no key is id
    in any case; an id that isn't a GUID keeps its value and the row's id is the digest. Blank lines are left out. Files are read in splits, line by
    line: line_no grows along a file but isn't dense. Headers, one a file, are joined back.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("line_no"), F.rtrim("value").alias("line"))
    header = lines.where("_at = 0").groupBy("file").agg(F.min(F.struct("line_no", "line")).alias("_first"))
    rows = lines.join(header, "file").where("line_no != _first.line_no and trim(line) != ''").withColumn("_h", _trimmed(F.split("_first.line", ","))).withColumn("_v", _trimmed(F.split("line", OUTSIDE_QUOTES)))
    twice = F.size(F.array_distinct("_h")) != F.size("_h")
    error = F.when(twice, "header has a name twice").when(F.size("_h") != F.size("_v"), "number of values differs from the header")
    rows = rows.withColumn("error", error)
    good = rows.where("error is null").withColumn("data", F.map_from_arrays("_h", "_v"))
    fresh = F.sha2(F.concat_ws("\x1f", "file", F.col("line_no").cast("string")), 256)
    good = good.withColumn("_given", F.try_element_at(F.transform(F.filter(F.map_entries("data"), lambda e: F.lower(e["key"]) == "id"), lambda e: e["value"]), F.lit(1)))
    good = good.withColumn("id", F.when(F.col("_given").rlike(GUID), F.col("_given")).otherwise(fresh))
    good = good.withColumn("data", F.when(F.col("_given").isNull(), F.map_concat("data", F.create_map(F.lit("Id"), fresh))).otherwise(F.col("data")))
    return good.select("file", "line_no", "id", "data"), rows.where("error is not null").select("file", "line_no", "line", "error")


def as_csv_rows(df: DataFrame) -> DataFrame:
    """Every column as a string, nulls empty."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv_maps(df: DataFrame, path: str) -> None:
    as_csv_rows(df).write.option("header", True).option("emptyValue", "").csv(path)
