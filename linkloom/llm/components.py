"""Links among items that share keys, and the connected components of links, as rounds of shuffles by key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stage


def connected_components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b): root is the smallest id of its component.

    Every edge runs from its larger end ``a`` to its smaller end ``b``. A round hangs a node and its smaller neighbours on the smallest of them, then
    moves each edge's smaller end to what that end hangs on itself. It ends when nothing moved: then every node has one edge, to its root. A node's
    smallest neighbour comes from a grouping that combines in the map tasks, and joins are written at once, so that Spark can split a
    node with very many edges; no task ever holds all edges of a node.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while True:
        least = stage(edges.groupBy("a").agg(F.min("b").alias("m")))
        hung = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        drawn = least.select("a", F.col("m").alias("b"), F.lit(False).alias("hung")).unionByName(hung.withColumn("hung", F.lit(True)))
        drawn = drawn.join(least.select(F.col("a").alias("node"), "m"), F.col("b") == F.col("node"), "left")
        moved = stage(drawn.select("a", F.coalesce("m", "b").alias("b"), (F.col("hung") | F.col("m").isNotNull()).alias("moved")))
        discard(edges, least)
        again = bool(moved.agg(F.max("moved")).first()[0])
        edges = moved
        if not again:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


#: Members of a tile: the product of two tiles has at most its square of entries, in one task.
TILE = 256
SMALL = 32  # the ids of a key are paired in a join up to so many, tile by tile beyond
SALTS = 1024  # parts of a common key


def figures_of_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (key, id, common) in order, once each, with the first id of their key and the key's number of ids; uncommon keys of one id are left out, and
    common keys pass without these figures. The last key of a batch waits for the next batch if it isn't a common one."""
    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

    def figures(key: np.ndarray, ids: np.ndarray, common: np.ndarray) -> pa.RecordBatch:
        new = np.append(True, key[1:] != key[:-1])
        keep = new | np.append(True, ids[1:] != ids[:-1])
        key, ids, common, start = key[keep], ids[keep], common[keep], np.flatnonzero(new[keep])
        size = np.diff(np.append(start, len(key)))
        first, n = np.repeat(ids[start], size), np.repeat(size, size)
        some = common | (n > 1)
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (key, ids, common, first, n.astype(np.int64))], names=["key", "id", "common", "first", "size"])

    for batch in batches:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, batch.columns, strict=True)]
        if not len(held[0]):
            continue
        at = len(held[0]) if held[2][-1] else int(np.searchsorted(held[0], held[0][-1]))
        if at:
            yield figures(*[h[:at] for h in held])
            held = [h[at:] for h in held]
    if len(held[0]):
        yield figures(*held)


def key_groups(keys: DataFrame) -> DataFrame:
    """(key, id, first, size), staged, of ``keys`` (key, id, common) for keys of several ids: first is the smallest of them, size their number.

    One shuffle by key, sorted and then read key by key. The ids of keys marked as common, of which there is a fixed number at most, are dealt into
    ``SALTS`` parts instead, and these keys' figures come from a grouping that combines in the map tasks.
    """
    part = F.when(F.col("common"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0))
    rows = keys.select("key", "id", "common").repartition("key", part).sortWithinPartitions("key", "id")
    rows = stage(rows.mapInArrow(figures_of_keys, "key long, id long, common boolean, first long, size long"))
    whole = rows.where("common").groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("size")).where("first != last").drop("last")
    common = rows.where("common").select("key", "id").join(F.broadcast(whole), "key")
    out = stage(rows.where("not common").select("key", "id", "first", "size").unionByName(common))
    discard(rows)
    return out


def best_pairs(groups: DataFrame, agree: int) -> DataFrame:
    """(a, b): every id with the one first id that it shares most keys with, ``agree`` at least. Their number grows with the ids, not with a group's square."""
    held = groups.where("id != first").groupBy("id", "first").agg(F.count("*").alias("n")).where(F.col("n") >= agree)
    return held.groupBy(F.col("id").alias("a")).agg(F.max_by("first", F.struct("n", F.bitwise_not("first"))).alias("b"))


def with_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with every fact of both, as _a and _b."""
    for c in "ab":
        pairs = pairs.join(facts.select(*[F.col(x).alias(c if x == "id" else f"{x}_{c}") for x in facts.columns]), c)
    return pairs


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def small_pairs(groups: DataFrame, facts: DataFrame, roots: DataFrame, likely: Column, agree: int) -> DataFrame:
    """(a, b), a < b, of different roots and ``likely`` by their facts, that share ``agree`` keys of few ids at least."""
    few = stage(with_roots(groups.where(f"size <= {SMALL}").select("key", "id").join(facts, "id"), roots))
    sides = [few.select("key", *[F.col(x).alias(c if x == "id" else f"{x}_{c}") for x in few.columns if x != "key"]) for c in "ab"]
    pairs = sides[0].join(sides[1], "key").where(likely & F.expr("a < b and root_a != root_b")).select("a", "b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= agree).select("a", "b")


def crowded_rows(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, id, first, root) of the keys of many ids that hold more than one root."""
    rows = stage(with_roots(groups.where(f"size > {SMALL}").select("key", "id", "first"), roots))
    several = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return rows.join(several, "key", "left_semi")


def link_components(groups: DataFrame, facts: DataFrame, verify: Callable[[DataFrame], DataFrame], cross: Callable[[DataFrame], DataFrame], likely: Column, agree: int) -> DataFrame:
    """(id, root) of every id that has a link, where all links join ids that share at least ``agree`` keys and are ``likely``.

    ``groups`` is of :func:`key_groups`, ``facts`` a row for each id with what verifying needs. First every id of a key with many ids is held against the
    one smallest id of a key that it shares most such keys with: ``verify`` takes these pairs (a, b, and each fact with _a and _b) and returns those
    that are links. Then pairs from keys of few ids are counted, and those below ``agree`` or not likely are discarded. The ids of the other pairs, and those of keys of
    many ids that aren't one component by now, are clusters; their members are dealt into tiles in the order of their components, and every
    two tiles that hold more than one component between them are given to ``cross`` (members with facts, see :func:`tile_pairs`), which returns links
    (a, b) among them. A pair that shares a key of many ids meets there, any other one shares ``agree`` keys of few: none is left out.
    """
    pairs = stage(with_facts(best_pairs(groups.where(f"size > {SMALL}"), agree), facts).where(likely))
    links = stage(verify(pairs).select("a", "b"))
    roots = stage(connected_components(links))
    few = stage(small_pairs(groups, facts, roots, likely, agree))
    many = stage(crowded_rows(groups, roots).where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct())
    discard(groups, pairs)
    clusters = connected_components(few.unionByName(many))
    members = stage(with_roots(clusters.select("id", F.col("root").alias("cluster")), roots))
    several = members.groupBy("cluster").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("cluster")
    members = stage(members.join(several, "cluster", "left_semi").join(facts, "id"))
    discard(few, many)
    if members.isEmpty():
        return roots
    more = stage(cross(members).select("a", "b"))
    if more.isEmpty():
        return roots
    return connected_components(links.unionByName(more))


def tile_pairs(members: DataFrame) -> DataFrame:
    """``members`` (id, cluster, root, ...) once for each pair of tiles that their tile is in: with cluster, i, j and side (0 for tile i, 1 for tile j).

    Members of a cluster are numbered by root; ``TILE`` of them are a tile. Tile pairs of one root have nothing to add and are left out: tiles of the
    cluster's largest component meet only tiles that hold others. Clusters of more than eight tiles are split by a hash before the numbering, so that no task orders a whole one.
    """
    sizes = members.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    main = stage(sizes.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.ceil(F.sum("n") / (8 * TILE)).alias("parts")))
    part = members.join(main.select("cluster", "parts"), "cluster").withColumn("part", F.pmod(F.xxhash64("root", F.pmod(F.xxhash64("id"), F.lit(16))), F.col("parts"))).drop("parts")
    part = stage(part)
    place = F.floor((F.row_number().over(Window.partitionBy("cluster", "part").orderBy("root", "id")) - 1) / TILE)
    part = stage(part.withColumn("tile", F.col("part") * F.lit(1 << 32) + place))
    tiles = part.groupBy("cluster", "tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).join(main.drop("parts"), "cluster")
    tiles = stage(tiles.select("cluster", "tile", "lo", "hi", (~((F.col("lo") == F.col("main")) & (F.col("hi") == F.col("main")))).alias("other")))
    x = tiles.where("other").select("cluster", *[F.col(c).alias(f"{c}_x") for c in ("tile", "lo", "hi")])
    y = tiles.select("cluster", *[F.col(c).alias(f"{c}_y") for c in ("tile", "lo", "hi", "other")])
    two = x.join(y, "cluster").where("(not other_y or tile_x <= tile_y) and not (lo_x = hi_x and lo_y = hi_y and lo_x = lo_y)")
    two = two.select("cluster", F.least("tile_x", "tile_y").alias("i"), F.greatest("tile_x", "tile_y").alias("j"))
    sides = two.select("cluster", "i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("side"))
    sides = sides.withColumn("tile", F.when(F.col("side") == 0, F.col("i")).otherwise(F.col("j")))
    return part.drop("part").join(sides, ["cluster", "tile"]).drop("tile")


def star_tiles(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) as rows like those of :func:`tile_pairs`: every ``b`` with at most about ``TILE`` of its ``a`` at a time."""
    parts = stage(pairs.groupBy("b").agg(F.ceil(F.count("*") / TILE).alias("parts")))
    a = pairs.join(parts, "b").select(F.col("b").alias("cluster"), F.pmod(F.xxhash64("a"), F.col("parts")).alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1).alias("side"), F.col("a").alias("id"), F.col("a").alias("root"))
    b = parts.select(F.col("b").alias("cluster"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"), F.col("b").alias("id"), F.col("b").alias("root"))
    return a.unionByName(b)
