"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Open bins are ordered by what is left in them. A bin carries a bitmap of its duplicate clusters and, for its sources, one bitmap
for each allowed piece of a source. A piece looks for the tightest bin that holds it, and goes on to that bin's successors until
one has no conflict; if none does, it opens a bin.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_words, stage, text_or_empty

CAPACITY = 2048
SHARD = 8192


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece (size, source, cluster), taken from large to small; sources and clusters are small numbers, the places of their bits."""
    bins: list[list] = []  # clusters bitmap, [source bitmap of the 1st, 2nd, ... piece]
    spare: list[tuple[int, int]] = []  # (room left, bin), ascending
    out = [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][0], i)):
        size, source, cluster = pieces[i]
        source, cluster = 1 << source, 1 << cluster
        k = bisect_left(spare, (size, -1))
        while k < len(spare) and (bins[spare[k][1]][0] & cluster or bins[spare[k][1]][1][-1] & source):
            k += 1
        if k < len(spare):
            room, b = spare.pop(k)
        else:
            room, b = capacity, len(bins)
            bins.append([0, [0] * per_source])
        bins[b][0] |= cluster
        held = bins[b][1]
        held[next(j for j in range(per_source) if not held[j] & source)] |= source
        if room - size > 0:
            insort(spare, (room - size, b))
        out[i] = b
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = 2, cluster: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row per piece: bin_id, position, doc_id, source, piece, start_word, n_words.

    ``docs`` has doc_id, text and source; ``cluster`` names a column of duplicate clusters, by default documents with equal text are one.
    A document longer than ``capacity`` words is cut into pieces of that length and a rest; whole-length pieces fill a bin each. A bin
    holds no two pieces of one cluster and at most ``per_source`` of one source (nulls count as one source). Documents without words
    (empty or null text) need no room: they are one piece of 0 words in bin -1. Repeated rows are packed each by itself.

    Pieces are dealt by a hash of doc_id, source, size and cluster into shards of about ``shard`` documents, each packed by itself, so that neither a hot
    source or doc_id nor a large group of copies meets in one task; every shard may leave its last bins part empty. Sources and clusters are
    numbered within a shard, so that bitmaps hold them exactly. Bins are named by shard and number, whatever the order of the input.
    """
    key = F.xxhash64(F.col(cluster)) if cluster else F.xxhash64(text_or_empty())
    sized = stage(docs.select("doc_id", "source", key.alias("_cluster"), count_words(text_or_empty()).alias("_size")))
    shards = max(1, -(-sized.count() // shard))
    start = F.explode(F.when(F.col("_size") > 0, F.sequence(F.lit(0).cast("long"), F.col("_size") - 1, F.lit(capacity).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    pieces = (
        sized.withColumn("_shard", F.pmod(F.xxhash64(F.lit(5), "doc_id", "source", "_cluster", "_size"), F.lit(shards)))
        .withColumn("start_word", start)
        .withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("_size") - F.col("start_word")))
        .withColumn("piece", (F.col("start_word") / capacity).cast("int"))
    )
    columns = ["doc_id", "source", "piece", "start_word", "n_words"]
    none = pieces.where("n_words = 0").select(F.lit("-1").alias("bin_id"), F.lit(0).alias("position"), *columns)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "_cluster", "source"], kind="stable").reset_index(drop=True)
        source, cluster = pd.factorize(rows["source"], use_na_sentinel=False)[0], pd.factorize(rows["_cluster"])[0]
        rows["_bin"] = best_fit(list(zip(rows["n_words"].tolist(), source.tolist(), cluster.tolist(), strict=True)), capacity, per_source)
        rows["position"] = rows.groupby("_bin").cumcount().astype("int32")
        rows["bin_id"] = [f"s{key[0]}-{b}" for b in rows["_bin"]]
        return rows[["bin_id", "position", *columns]]

    part = pieces.where("n_words > 0").select("_shard", "_cluster", *columns)
    return part.groupBy("_shard").applyInPandas(run, none.schema).unionByName(none)
