"""A bitmap of fixed size that takes most rows out of the large side of a look-up before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 23  # 2**23 bits: at most 2**17 rows of 64, whatever the number of keys


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS))


def may_match(large: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """Rows of ``large`` whose ``key`` may be among the ``wanted`` keys: all that are, and few others while there are fewer keys than bits. A null key matches nothing.

    The bitmap is aggregated in the map tasks and broadcast; the exact look-up that follows sees what passes.
    """
    bits = wanted.select(_bit(wanted_key).alias("_b")).select(F.shiftright("_b", 6).alias("_word"), F.expr("shiftleft(1L, cast(_b & 63 as int))").alias("_mask"))
    bitmap = bits.groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    probed = large.where(key.isNotNull()).withColumn("_b", _bit(key)).withColumn("_word", F.shiftright("_b", 6))
    return probed.join(F.broadcast(bitmap), "_word").where("(_bits & shiftleft(1L, cast(_b & 63 as int))) != 0").select(*large.columns)
