"""Folders of JSON messages as streams, and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csvmaps import GUID


def _file_rows(raw: DataFrame, schema: str) -> DataFrame:
    name = F.regexp_replace(F.element_at(F.split("_file", "/"), -1), r"\.[^.]*$", "")
    parsed = F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.select(F.when(name.rlike(GUID), name).otherwise(F.sha2("_file", 256)).alias("id"), F.col("_file").alias("file"), F.col("value").alias("payload"), parsed.alias("doc"))
    bad = F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()
    return rows.withColumn("error", F.when(bad, F.lit("not a document of the schema"))).withColumn("doc", F.when(~bad, F.col("doc").dropFields("_corrupt")))


def file_messages(spark: SparkSession, folder: str, schema: str, glob: str = "*.json", archive: str | None = None) -> DataFrame:
    """A stream of one row per file: id (the file's name where it is a GUID, else a digest of its path), file, payload, doc, error.

    Existing and new files are taken; with ``archive`` consumed files move there. Rows with an error belong in a dead-letter sink.
    """
    reader = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return _file_rows(reader.load(folder).select("value", F.col("_metadata.file_path").alias("_file")), schema)


def read_file_messages(spark: SparkSession, folder: str, schema: str, glob: str = "*.json") -> DataFrame:
    """The same rows from the files that are there now."""
    raw = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    return _file_rows(raw.select("value", F.col("_metadata.file_path").alias("_file")), schema)


def publish_json(df: DataFrame, folder: str) -> None:
    """Append messages as JSON lines; the id stays a column."""
    df.write.mode("append").json(folder)


def publish_deadletter(df: DataFrame, folder: str) -> None:
    """Append failed messages (stage, target and error columns) to the dead-letter table."""
    df.write.mode("append").parquet(folder)


def publish_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """Write a batch's messages to its own folder: a batch that runs again replaces what it wrote."""
    df.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
