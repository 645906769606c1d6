"""Tables that several branches of a plan read, written once to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder's name under ``spark.checkpoint.dir``."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-nodes-")
    return f"{shared.rstrip('/')}/nodes-{uuid.uuid4().hex}"


def staged(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` from a new folder under ``spark.checkpoint.dir``: it is worked out once, and a lost executor costs nothing. The folder goes with the
    application's other checkpoints. With ``by`` every value of that column has a folder, so that a reader of one value reads that one. Only a local master without that setting takes a temporary folder."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])


def buckets(spark: SparkSession) -> int:
    """Spark's number of shuffle partitions, as far as a bucketed table may have so many buckets."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 100_000)


def clustered(df: DataFrame, key: str, *order: str, parts: int | None = None, dealt: bool = False) -> DataFrame:
    """``df`` dealt out by ``key`` once, into ``parts`` buckets (as many as there are shuffle partitions) in a new folder as :func:`staged`'s, each sorted by key and ``order``.

    What is read back is known to be partitioned by ``key``: windows, groupings and joins by it, or by it and more columns, need no further exchange. The catalogue holds the name only while the table is written.
    ``dealt`` says that ``df`` comes in that many partitions by ``key`` already.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    name, n = f"linkloom_{uuid.uuid4().hex}", min(parts, 100_000) if parts else buckets(spark)
    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).sortBy(key, *order).format("parquet").option("path", path).saveAsTable(name)
    out = spark.table(name).select(*[F.col(f"`{c}`") for c in df.columns])
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return out
