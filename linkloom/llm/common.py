"""Shared plumbing: staged tables in the cluster's shared folder, and a fixed-size membership filter."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_BITS = 23  # 2**23 bits: at most 2**17 rows of 64 bits, whatever the number of ids

#: A word is a run of code points other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset (tests)."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-linkloom-")
        context.setCheckpointDir(path)
    return path.rstrip("/")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to a new folder of the shared directory and read it back: lineage ends there and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/linkloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_in = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete the folders of tables from :func:`stage` that nothing reads any more; other tables are left alone. Spark deletes the shuffles
    behind them when the driver's JVM has collected their plans."""
    for df in staged:
        path = getattr(df, "staged_in", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
            context._jvm.System.gc()


def membership(ids: DataFrame, *key: str) -> DataFrame:
    """A bitmap of the hashes of ``key`` over ``ids``: rows (word, bits), never more than 2**17 of them."""
    bit = F.pmod(F.xxhash64(*key), F.lit(1 << FILTER_BITS))
    return (
        ids.select(bit.alias("b"))
        .select(F.shiftright("b", 6).alias("_word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("_mask"))
        .groupBy("_word")
        .agg(F.bit_or("_mask").alias("_bits"))
    )


def flagged(df: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    """``df`` with _maybe: whether the bitmap of ``ids`` has the bit of the row's ``key``."""
    bit = F.pmod(F.xxhash64(*key), F.lit(1 << FILTER_BITS))
    probe = df.withColumn("_b", bit).withColumn("_word", F.shiftright("_b", 6))
    flag = F.coalesce(F.expr("(_bits & shiftleft(1L, cast(_b & 63 as int))) != 0"), F.lit(False))
    return probe.join(F.broadcast(membership(ids, *key)), "_word", "left").withColumn("_maybe", flag).select(*[F.col(f"`{c}`") for c in df.columns], "_maybe")


def may_contain(df: DataFrame, ids: DataFrame, *key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``ids`` (same column names); false positives pass, members always do.

    The bitmap is broadcast: its size is fixed at 2**17 rows, so it doesn't grow with the data. When the ids are so many that
    most bits are set, nearly all rows pass and the exact join that follows does all the work.
    """
    return flagged(df, ids, *key).where("_maybe").drop("_maybe")


def split_by(df: DataFrame, ids: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` may be among ``ids``, and rows whose key surely isn't."""
    told = flagged(df, ids, *key)
    return told.where("_maybe").drop("_maybe"), told.where("not _maybe").drop("_maybe")


SIEVE_BITS = 26  # 8 MB, whatever the number of ids


class Sieve:
    """A bitmap with two bits for every id, for use in tasks on Arrow batches: ids that were put in always pass, others seldom, until there are tens of millions of ids."""

    def __init__(self, ids: DataFrame, seed: int, key: str = "doc_id"):
        self.seed, self.key = seed, key
        bits = ids.select(F.explode(F.array(*self._places())).alias("b")).select(F.shiftright("b", 6).alias("word"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("mask"))
        words = bits.groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
        bitmap = np.zeros(1 << (SIEVE_BITS - 6), np.int64)
        bitmap[words.column("word").to_numpy().astype(np.int64)] = words.column("mask").to_numpy().astype(np.int64)
        self.sent = ids.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def _places(self):
        return [F.pmod(F.xxhash64(F.lit(self.seed + k), F.col(self.key)), F.lit(1 << SIEVE_BITS)) for k in (0, 1)]

    def places(self):
        """The column that :func:`passing` needs: null for a null id."""
        return F.when(F.col(self.key).isNotNull(), F.array(*self._places()))


def passing(bitmap: np.ndarray, places: pa.Array) -> np.ndarray:
    """Which rows' ids may be in the bitmap."""
    out = places.is_valid().to_numpy(zero_copy_only=False)
    b = places.drop_null().flatten().to_numpy().astype(np.uint64).reshape(-1, 2)
    out[out] = (bitmap[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).all(axis=1)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def count_words(text):
    """Number of words of a string column."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")
