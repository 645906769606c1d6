"""Raw documents to packed training bins, as stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm import jaccard, linededup, mixing, packing, quality
from linkloom.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    trusted = quality.trusted_documents(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs.select(*COLUMNS), trusted).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, all but the first of each group; a document that loses its last words this way goes too."""
    out = linededup.dedup_lines(docs.select(*COLUMNS), bits=None, min_words=1, fuzzy_words=1)
    return out.where("not emptied").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, Jaccard 0.8)."""
    return jaccard.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: one draw for one row, whatever ids are repeated or null."""
    row = F.xxhash64(*COLUMNS)
    place = F.row_number().over(Window.partitionBy(row).orderBy(*COLUMNS))
    keyed = stage(docs.select(*COLUMNS, F.concat_ws("-", row.cast("string"), place.cast("string")).alias("_row")))
    copies = mixing.mix(keyed.select(F.col("_row").alias("doc_id"), "source", "text")).where("copies > 0")
    taken = keyed.join(stage(copies.select(F.col("doc_id").alias("_row"), F.col("copies").alias("_copies"))), "_row")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of bins of 2048 words: one row per piece of a document."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: The likelihood ratio, fuzzy lines, the cube method and best fit are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
