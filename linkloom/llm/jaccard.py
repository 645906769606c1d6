"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Columns are dealt into blocks by their hash, into more blocks than the columns that two linked rows can differ in, so that such rows are equal in some block
that isn't empty: rows that are equal in a block meet (see :func:`block_keys`), and pairs whose sizes or parities rule the bound out are discarded. What a
block holds is far rarer than one n-gram, so that the rows that meet don't become more by chance as documents do. For the pairs that are left the overlap is
counted over all columns, block by block, and held against the bound of their sizes.

Documents with equal sets are one row of the matrix. Components need no more links than connect them, see
:func:`~linkloom.llm.components.link_components`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, may_contain, stage
from .components import key_groups, link_components, star_tiles, tile_pairs
from .ordering import RareFirst, rare_first
from .textvec import Tokenizer, mix, shingles


ROUNDS = 4  # keys are grouped in so many turns, by their values, so that only a part of them is in a shuffle at a time

#: What share of a row's columns is taken to be rare ones when the blocks are counted out; rows with fewer have keys of their own.
RARE = 0.75


def _filled(n: float, k: int) -> float:
    """How many of ``k`` blocks ``n`` columns fill at least, but for four standard deviations."""
    empty = math.exp(-n / k)
    return k * (1 - empty) - 4 * math.sqrt(k * empty * max(0.0, 1 - (1 + n / k) * empty))


@dataclass(frozen=True)
class Zones:
    """Ranges of set sizes, for links whose smaller set is in the range: ``low`` is the least size of each and ``high`` the largest, ``apart`` how many
    elements at most only one of two linked sets has, ``blocks`` how many blocks the elements are dealt into."""

    low: np.ndarray
    high: np.ndarray
    apart: np.ndarray
    blocks: np.ndarray


@cache
def zones(share: tuple[int, int]) -> Zones:
    """The ranges for links of ``share`` = (num, den). The larger of two linked sets has den / num times the smaller one's size n at most, so that n * (den - num) / num elements at most aren't common ones."""
    num, den = share
    if 2 * num <= den:
        raise ValueError("the threshold must be over one half")
    low, apart, blocks = [1], [], []
    while low[-1] < 1 << 31:
        low.append(max(low[-1] + 1, low[-1] * 7 // 5))
        apart.append((low[-1] - 1) * (den - num) // num)
        n, k = RARE * low[-2], apart[-1] + 1
        while _filled(n, k) <= apart[-1] + 1 and k < 64 * low[-2]:
            k += 1 + k // 50
        blocks.append(k)
    return Zones(np.array(low[:-1]), np.array(low[1:]) - 1, np.array(apart), np.array(blocks))


def block_keys(items: np.ndarray, rare: np.ndarray, n: np.ndarray, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets that stand one after another in ``items`` (``n`` elements each): the keys and their number for each set. Linked sets share one.

    A set has keys for each range of :func:`zones` that its links' smaller sets may be in: what it holds of every block, as one hash. Each element that only
    one of two sets has changes one block. So they are equal in a filled block if either fills more blocks than such elements there are. Only elements
    that are ``rare`` (by one rule for all sets) count; sets that fill too few blocks with them, few ones, have keys over all elements too, and if these don't do either, keys of their empty blocks.
    """
    num, den = share
    z, owner, whole = zones(share), np.repeat(np.arange(len(n)), n), mix(items + np.uint64(0x2545F4914F6CDD1D))
    inner, place = mix(whole), whole >> np.uint64(32)
    halves = (inner & np.uint64(0xFFFFFFFF)).astype(float), (inner >> np.uint64(32)).astype(float)
    sets, keys = [], []

    def deal(some: np.ndarray, zone: np.ndarray, every: bool) -> None:
        """Keys of the sets ``some``, each for its ``zone``."""
        k = z.blocks[zone]
        start, width = np.full(len(n), -1), np.zeros(len(n), np.uint64)
        start[some], width[some] = np.cumsum(k) - k, k
        mine = np.flatnonzero((start[owner] >= 0) & (every | rare))
        block = (place[mine] * width[owner[mine]] >> np.uint64(32)).astype(np.int64)
        slot, total = start[owner[mine]] + block, int(k.sum())
        filled = np.bincount(slot, minlength=total) > 0
        low, high = (np.bincount(slot, h[mine], total).astype(np.uint64) for h in halves)
        of, number = np.repeat(np.arange(len(some)), k), np.arange(total) - np.repeat(start[some], k)
        few = np.add.reduceat(filled.astype(np.int64), start[some]) <= z.apart[zone]
        given = filled | few[of] if every else filled
        tag = (zone[of] * 2 + every).astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)
        keys.append(mix(mix(low + high * np.uint64(0xD1342543DE82EF95)) + mix(tag))[given])
        sets.append(some[of[given]])
        if few.any() and not every:
            deal(some[few], zone[few], True)

    own = np.searchsorted(z.low, n, "right") - 1
    while True:
        some = np.flatnonzero((own >= 0) & (n > 0))
        some = some[z.high[own[some]] * den >= n[some] * num]
        if not len(some):
            break
        linked = some[z.apart[own[some]] > 0]
        if len(linked):
            deal(linked, own[linked], False)
        own = np.where(np.isin(np.arange(len(n)), some), own - 1, -1)
    if not keys:
        return np.empty(0, np.uint64), np.zeros(len(n), np.int64)
    sets = np.concatenate(sets)
    return np.concatenate(keys)[np.argsort(sets, kind="stable")], np.bincount(sets, minlength=len(n))


def set_ids(items: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for each set of hashes; sets stand one after another in ``items``, none is empty."""
    total, odd = np.add.reduceat(mix(items), start), np.bitwise_xor.reduceat(mix(items * np.uint64(0xD1342543DE82EF95) + np.uint64(1)), start)
    return mix(total ^ (odd * np.uint64(0x2545F4914F6CDD1D) + size.astype(np.uint64)))


def _sets(tokens: Tokenizer, texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int | None]]]:
    """Chunk by chunk of texts: elements of all sets, ascending within each; the sets' sizes; their ids, None for an empty set."""
    for w in tokens.chunks(texts):
        runs, sets = shingles(w.hash, size), []
        for lo, hi in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist(), strict=True):
            mine = np.sort(runs[lo : hi - size + 1]) if hi - lo >= size else shingles(w.hash[lo:hi], size)
            if len(mine) > 1:
                first = np.empty(len(mine), bool)
                first[0] = True
                np.not_equal(mine[1:], mine[:-1], out=first[1:])
                mine = mine[first]
            sets.append(mine)
        n = np.array([len(x) for x in sets], np.int64)
        items, some = np.concatenate(sets), np.flatnonzero(n)
        ids: list[int | None] = [None] * len(n)
        if len(some):
            start = np.cumsum(n) - n
            for i, x in zip(some.tolist(), set_ids(items, start[some], n[some]).view(np.int64).tolist(), strict=True):
                ids[i] = x
        yield items, n, ids


def shingle_order(docs: DataFrame, size: int) -> RareFirst:
    """The columns known as common. Texts are counted as they follow each other: a few n-grams across their borders don't matter here."""

    def grams(texts: pa.Array) -> Iterator[np.ndarray]:
        for w in Tokenizer(fold=True).chunks(texts):
            yield shingles(w.hash, size)

    return rare_first(docs, grams)


def incidence(docs: DataFrame, size: int, share: tuple[int, int], order: RareFirst) -> DataFrame:
    """doc_id, n_shingles, set_id, parity, keys_0 and so on: one narrow pass over whole texts. set_id is null for a document without words; a
    set's keys are given once a task, by their rounds, with the first document that has it. parity has 256 bits, each of the number of elements that hash to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, seen = Tokenizer(fold=True), set()
        for batch in batches:
            at = 0
            for items, n, ids in _sets(tokens, batch.column(1), size):
                new = np.zeros(len(n), bool)
                for i, x in enumerate(ids):
                    new[i] = x is not None and x not in seen
                    seen.add(x)
                own = items[np.repeat(new, n)]
                keys, count = block_keys(own, order.levels(own) == 0, n[new], share)
                of, turn = np.repeat(np.flatnonzero(new), count), keys % np.uint64(ROUNDS)
                ends = [np.cumsum(np.bincount(of[turn == r] + 1, minlength=len(n) + 1)).astype(np.int32) for r in range(ROUNDS)]
                lists = [pa.ListArray.from_arrays(pa.array(ends[r]), pa.array(keys[turn == r].view(np.int64))) for r in range(ROUNDS)]
                odd = np.bincount(np.repeat(np.arange(len(n)) * 256, n) + (items & np.uint64(255)).astype(np.int64), minlength=256 * len(n)) & 1
                parity = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 4), pa.array(np.packbits(odd.astype(np.uint8)).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(n), pa.array(ids, pa.int64()), parity, *lists], names=["doc_id", "n_shingles", "set_id", "parity", *names])
                at += len(n)

    kind, names = docs.schema["doc_id"].dataType.simpleString(), [f"keys_{r}" for r in range(ROUNDS)]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, set_id long, parity array<long>, {', '.join(f'{x} array<long>' for x in names)}")


def in_reach(tile: pa.Table, share: tuple[int, int]) -> np.ndarray:
    """The rows of a pair of tiles that have a row of another root on the other side whose size and parity don't rule a link out."""
    num, den = share
    side, n, root = (tile.column(c).to_numpy() for c in ("side", "n", "root"))
    parity = np.stack([tile.column(f"p{i}").to_numpy().view(np.uint64) for i in range(4)], axis=1)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    x, y = n[left][:, None], n[right][None, :]
    turned = sum(np.bitwise_count(parity[left, i][:, None] ^ parity[right, i][None, :]).astype(np.int64) for i in range(4))
    likely = (np.minimum(x, y) * den >= np.maximum(x, y) * num) & (turned * (den + num) <= (x + y) * (den - num)) & (root[left][:, None] != root[right][None, :])
    return np.unique(np.concatenate([left[likely.any(axis=1)], right[likely.any(axis=0)]]))


def _products(docs: DataFrame, size: int, share: tuple[int, int]):
    """Two functions: one keeps those of given pairs of sets that reach the threshold, one finds such pairs between tiles of sets."""
    num, den = share

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer(fold=True)
        for batch in batches:
            at = 0
            for items, n, ids in _sets(tokens, batch.column(1), size):
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(items.view(np.int64)))], names=["doc_id", "id", "items"])
                at += len(n)

    kind = docs.schema["doc_id"].dataType.simpleString()

    def products(rows: DataFrame) -> DataFrame:
        """The links within every (cluster, i, j) of ``rows`` (with side, id, root, doc_id): a set's elements come from one narrow pass over the texts
        that may be meant, and are shuffled once for each tile pair of theirs."""
        rows = stage(rows.select("cluster", "i", "j", "side", "id", "root", "doc_id"))
        sets = may_contain(docs.select("doc_id", "text"), rows.select("doc_id").distinct(), "doc_id").mapInArrow(rows_of, f"doc_id {kind}, id long, items array<long>")

        def product(tile: pa.Table) -> pa.Table:
            side, ids = tile.column("side").to_numpy(), tile.column("id").to_numpy()
            _, once = np.unique(np.stack([side.astype(np.int64), ids]), axis=1, return_index=True)  # repeated rows of one doc_id
            if len(once) < len(ids):
                tile = tile.take(pa.array(once))
                side, ids = side[once], ids[once]
            root, items = tile.column("root").to_numpy(), tile.column("items").combine_chunks()
            size = np.diff(items.offsets.to_numpy())
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if side.any() else left
            both = overlaps(items.flatten().to_numpy(), size, left, right)
            linked = (both * den >= (size[left][:, None] + size[right][None, :] - both) * num) & (root[left][:, None] != root[right][None, :])
            a, b = forest(left[np.nonzero(linked)[0]], right[np.nonzero(linked)[1]], len(ids))
            return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

        return sets.join(rows, ["doc_id", "id"]).groupBy("cluster", "i", "j").applyInArrow(product, "a long, b long")

    def verify(pairs: DataFrame) -> DataFrame:
        docs_of = pairs.select(F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.col(f"doc_id_{c}").alias("doc_id")) for c in "ab"])).alias("x")).select("x.*").distinct()
        return products(star_tiles(pairs).join(docs_of, "id"))

    def cross(members: DataFrame) -> DataFrame:
        """Only rows that can have a link in a pair of tiles have their elements sent there."""
        about = [f"p{i}" for i in range(4)]
        rows = tile_pairs(members.select("id", "cluster", "root", "doc_id", "n", *about))
        kept = ["cluster", "i", "j", "side", "id", "root", "doc_id"]
        schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
        return products(rows.groupBy("cluster", "i", "j").applyInArrow(lambda tile: tile.take(pa.array(in_reach(tile, share))).select(kept), schema))

    return verify, cross


COLUMNS = 4096


def overlaps(items: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Overlap counts of the sets ``left`` with the sets ``right`` (of ``size``, one after another in ``items``), summed over blocks of columns."""
    values, column, count = np.unique(items, return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # items of one set only add nothing
    row = np.repeat(np.arange(len(size)), size)
    keep = count[column] > 1
    row, column = row[keep], shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        block = np.zeros((len(size), COLUMNS), np.float32)
        block[row[lo:hi], column[lo:hi] - at] = 1
        out += (block[left] @ block[right].T).astype(np.int64)
    return out


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Of the edges a-b among n nodes, so many as connect what all of them connect."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = ([], [])
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        tx, ty = top(x), top(y)
        if tx != ty:
            up[tx] = ty
            kept[0].append(x)
            kept[1].append(y)
    return kept


def jaccard_components(docs: DataFrame, size: int = 5, share: tuple[int, int] = (8, 10)) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text).

    Two documents link when the sets of their ``size``-word shingles (A-Z lower-cased; of fewer words, the whole sequence) have
    den * intersection >= num * union for ``share`` = (num, den). component_id is the smallest doc_id that links reach. A null or empty
    text has an empty set and links with nothing: its component is its own doc_id. Rows of equal doc_id are rows of their own, and all
    count for that id's component. A row without doc_id has its set counted but links with nothing but equal sets, and a null component only if its equals have no doc_id either. Other columns are not read.
    """
    base = stage(incidence(docs, size, share, shingle_order(docs, size)))
    told = stage(base.select("doc_id", "n_shingles", "set_id"))
    about = [F.min("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"), *[F.first(F.col("parity")[i]).alias(f"p{i}") for i in range(4)]]
    facts = stage(base.where("doc_id is not null and set_id is not null").groupBy(F.col("set_id").alias("id")).agg(*about))
    num, den = share
    # Sets in reach differ in at most (den - num) / (den + num) of both sizes; every element that only one has turns one bit.
    likely = F.expr(f"least(n_a, n_b) * {den} >= greatest(n_a, n_b) * {num} and ({' + '.join(f'bit_count(p{i}_a ^ p{i}_b)' for i in range(4))}) * {den + num} <= (n_a + n_b) * {den - num}")
    groups = [key_groups(base.select(F.explode(f"keys_{r}").alias("key"), F.col("set_id").alias("id"), F.lit(False).alias("common"))) for r in range(ROUNDS)]
    discard(base)
    roots = link_components(reduce(DataFrame.unionByName, groups), facts, *_products(docs, size, share), likely, agree=1)
    discard(*groups)
    rows = told.join(roots.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    rows = stage(rows)
    least = stage(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return rows.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, share: tuple[int, int] = (8, 10)) -> DataFrame:
    """``docs`` without the rows whose doc_id is not the smallest of its component; of repeated rows of one doc_id, all stay."""
    parts = jaccard_components(docs, size, share)
    out = stage(parts.where("doc_id != component_id").select(F.col("doc_id").alias("_out")).distinct())
    return docs.join(out, docs["doc_id"] == out["_out"], "left_anti")
