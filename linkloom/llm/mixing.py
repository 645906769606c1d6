"""Mixing sources to target weights by the cube method.

Every source gets a target share of all words; a document's expected number of copies is its source's target over its source's
size. The whole part of that is given to every document; the rest is an inclusion probability, and the cube method turns these
into 0 or 1 while it keeps, in every source, the number of documents and the number of words where they were: flight steps move
the probabilities of three documents along the null space of the two constraints until one of them is 0 or 1. Documents are dealt
into blocks, each block flies alone and leaves two undecided documents at most, blocks of those fly again, and so on until one
block a source is left, which with some documents kept back for it makes the landing problem. Blocks and draws depend on the row
and, for equal rows, their number alone, so that reruns agree and no id, text or repeated row makes a block of its own.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, stage, text_or_empty

#: Documents of a block in the first flight, about; and undecided documents of a block in the later ones.
BLOCK = 4096


def target_shares(totals: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """``totals`` (source, source_size) with target: by code point, null last, the sources weigh ``weights`` in turn and share
    ``share`` of all words; none gets more than ``cap`` times its size, the excess being reshared by weight.

    One row per source: the ordered windows run over this small table. Sources without words get 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    t = totals.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    # The level where min(cap * size, level * weight) sums to the whole: sources fill up in the order of cap * size / weight.
    t = t.withColumn("_fills", F.lit(cap) * F.col("source_size") / F.col("_w"))
    filling = Window.orderBy("_fills", F.col("source").asc_nulls_last())
    fill = filling.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = (
        t.withColumn("_rank", F.row_number().over(filling))
        .withColumn("_all", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("_full", F.lit(cap) * F.sum("source_size").over(fill))
        .withColumn("_left", F.sum("_w").over(everything) - F.sum("_w").over(fill) + F.col("_w"))
        .withColumn("_level", (F.col("_all") - F.col("_full") + F.lit(cap) * F.col("source_size")) / F.col("_left"))
    )
    # At the first source (in filling order) that the level does not fill, the level is final.
    t = t.withColumn("_final", F.min(F.when(F.col("_level") <= F.col("_fills"), F.struct("_rank", "_level"))).over(everything)["_level"])
    target = F.when(F.col("_final").isNull() | (F.col("_final") * F.col("_w") >= F.lit(cap) * F.col("source_size")), F.lit(cap) * F.col("source_size")).otherwise(F.col("_final") * F.col("_w"))
    return t.select("source", "source_size", target.cast("double").alias("target"))


EPS = 1e-9


def fly(p: list[float], size: list[float], order: list[int], counted: bool, rng: random.Random) -> list[int]:
    """Move the probabilities ``p`` (in place) of the documents ``order`` until nearly all are 0 or 1; returns the undecided ones.

    The sum of p * size never changes, with ``counted`` the sum of p neither. Up to two documents (or one) stay undecided.
    """
    need = 3 if counted else 2
    open_ = [i for i in order if EPS < p[i] < 1 - EPS]
    for i in order:
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
    active, rest = open_[:need], iter(open_[need:])
    while len(active) == need or (len(active) == 2 and size[active[0]] == size[active[1]]):
        if len(active) == 3:
            a, b, c = (size[i] for i in active)
            move = (c - b, a - c, b - a)
            if move == (0, 0, 0):
                move = (1.0, -1.0, 0.0)
        elif counted or size[active[0]] == size[active[1]]:
            move = (1.0, -1.0)
        else:
            move = (size[active[1]], -size[active[0]])
        up = down = math.inf
        for i, u in zip(active, move, strict=True):
            if u > 0:
                up, down = min(up, (1 - p[i]) / u), min(down, p[i] / u)
            elif u < 0:
                up, down = min(up, p[i] / -u), min(down, (1 - p[i]) / -u)
        step = up if rng.random() * (up + down) < down else -down
        still = []
        for i, u in zip(active, move, strict=True):
            p[i] += step * u
            if p[i] < EPS:
                p[i] = 0.0
            elif p[i] > 1 - EPS:
                p[i] = 1.0
            else:
                still.append(i)
        for i in rest:
            still.append(i)
            if len(still) == need:
                break
        active = still
    return active


def settle(p: list[float], size: list[float], rng: random.Random) -> None:
    """Decide a whole last block (``p`` in place), large documents first.

    The larger ones fly under both constraints; what they leave is drawn (the other way where only that can be made up for), and the words this
    adds or takes are spread over the smaller ones (a quarter of the words), which then fly under the constraint on words alone, down to one small
    document, drawn last.
    """
    order = sorted(range(len(p)), key=lambda i: -size[i])
    below, cut = 0.25 * sum(size), len(order)
    while cut and below > 0:
        cut -= 1
        below -= size[order[cut]]
    large, small = order[:cut], order[cut:]
    excess = 0.0
    up, down = sum(size[i] * (1 - p[i]) for i in small), sum(size[i] * p[i] for i in small)

    def beyond(drawn: float, i: int) -> float:
        total = excess + (drawn - p[i]) * size[i]
        return max(0.0, total - down, -total - up)

    for i in fly(p, size, large, True, rng):
        drawn = 1.0 if rng.random() < p[i] else 0.0
        if beyond(1 - drawn, i) < beyond(drawn, i):
            drawn = 1 - drawn
        excess += (drawn - p[i]) * size[i]
        p[i] = drawn
    for _ in range(8):
        movable = [i for i in small if size[i] and (p[i] < 1 if excess < 0 else p[i] > 0)]
        room = sum(size[i] for i in movable)
        if not room or abs(excess) < 1e-6:
            break
        shift = excess / room
        for i in movable:
            moved = min(1.0, max(0.0, p[i] - shift))
            excess -= (p[i] - moved) * size[i]
            p[i] = moved
    for i in fly(p, size, small, False, rng):
        drawn = 1.0 if rng.random() < p[i] else 0.0
        excess += (drawn - p[i]) * size[i]
        p[i] = drawn
    for i in small:  # what a single large document left over: the documents that make it smaller change sides, large ones first
        turned = excess + (1 - 2 * p[i]) * size[i]
        if abs(turned) < abs(excess):
            p[i], excess = 1 - p[i], turned


def _flight(last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_h", "doc_id", "size"], kind="stable", na_position="last")
        rng, p, size = random.Random(int(rows["_h"].iloc[0]) ^ len(rows)), rows["_p"].tolist(), rows["size"].astype(float).tolist()
        if last:
            settle(p, size, rng)
        else:
            fly(p, size, list(range(len(p))), True, rng)
        rows["_p"] = p
        return rows

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: how often the mix takes each row of ``docs`` (doc_id, text, source).

    size is the number of words (null or empty text: 0, such a row is kept with taken 0); rows with equal doc_id are drawn one by
    one; sources without any word get target 0 and copies 0. Only doc_id, source and text are read, other columns may have any name.
    Two scans of the text count words; everything after moves rows of a few numbers. No task holds more than about a block of rows, whatever ids are null or repeated.
    """
    sized = docs.select("doc_id", "source", count_words(text_or_empty()).alias("size"), F.xxhash64(text_or_empty()).alias("_text"))
    totals = stage(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs")))
    targets = target_shares(totals.select("source", "source_size"), weights, share, cap).withColumnRenamed("source", "_source")
    targets = stage(targets.join(totals.withColumnRenamed("source", "_source").select(F.col("_source").alias("_s"), "_docs"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + EPS)
    equal = sized.groupBy("doc_id", "source", "size", "_text").agg(F.count("*").alias("_n"))
    placed = equal.withColumn("_place", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))  # equal rows are counted first, then numbered
    known = ("doc_id", "source", "size", "_text", "_place")
    unit = F.pmod(F.xxhash64(F.lit(78), *known), F.lit(1 << 30)) / F.lit(1 << 30)
    rows = (
        placed.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_h", F.xxhash64(F.lit(77), *known))
        .withColumn("_whole", whole)
        .withColumn("_p", F.greatest(rate - whole, F.lit(0.0)))
        .withColumn("_blocks", F.when(unit * F.col("_docs") < block / 2, F.lit(0)).otherwise(F.ceil(F.col("_docs") / block)).cast("long"))
        .withColumn("_block", F.when(F.col("_blocks") > 0, F.pmod("_h", F.col("_blocks"))))
    )
    columns = ["doc_id", "source", "size", "source_size", "target", "_h", "_whole", "_p", "_blocks", "_block"]
    rows = stage(rows.select(*columns))  # _blocks 0: about half a block of documents of each source is kept for the last flight
    open_ = "_p > 0 and _p < 1"
    blocks = rows.agg(F.max("_blocks")).first()[0] or 0
    done, left = [], rows.where("_blocks > 0")
    while blocks > 1:  # a block leaves two rows, so block / 4 blocks' leavings fill half a new one
        flown = stage(left.groupBy("source", "_block").applyInPandas(_flight(False), rows.schema))
        done.append(flown.where(f"not ({open_})"))
        blocks = math.ceil(blocks / (block // 4))
        left = flown.where(open_).withColumn("_blocks", F.ceil(F.col("_blocks") / (block // 4))).withColumn("_block", F.pmod("_h", F.col("_blocks")))
    last = rows.where("_blocks = 0").unionByName(left)
    done.append(last.groupBy("source").applyInPandas(_flight(True), rows.schema))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    copies = (F.col("_whole") + F.col("_p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
