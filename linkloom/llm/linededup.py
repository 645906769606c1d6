"""Fuzzy line dedup: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence of each connected group.

A line's words are lower-cased (A-Z) and joined by one space; equal normal lines are one class. The 64 bits of a class's SimHash
(over its pairs of neighbouring words, which common words sway less than single ones) are cut into six blocks; lines that differ in at most three bits agree in three whole blocks, so each of the twenty triples of
blocks is a key. Classes that share a key link when they differ in at most ``bits`` bits and their edit similarity
in words, 1 - distance / longer length, is at least ``similarity``. Of every connected group the first line (by doc_id, then place) stays.

Without SimHash (``bits`` None) the edit similarity alone decides, and candidates leave no such pair out. An edit spoils two of a line's
two-word runs at most, so that two lines in reach share some of the first few in any order that holds for all lines; these are the keys,
rare ones first. Candidates whose lengths or word parities (each edit turns two of 256 bits at most) tell them apart are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import components
from .common import count_words, discard, flagged, may_contain, split_by, stage, text_or_empty
from .components import best_pairs, connected_components, crowded_rows, figures_of_keys, key_groups, link_components, small_pairs, tile_pairs, with_facts
from .ordering import GramCounts, RareFirst, order_of
from .textvec import Tokenizer, Words, mix

MIN_WORDS = 5
FUZZY_WORDS = 8
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
RUN = 2  # words of a run
KEYS = 1 << 18  # of a block, about
KEY_BYTES = 6
ANY = 255  # a length or place that does not go into a byte, or a place that is several
COMMON = 1 << 16  # runs that a task counts as common, at most
PAIRS = 1 << 20  # made at once
PARITIES = ("p0", "p1", "p2", "p3")  # 64 bits each
END = np.uint64(0x2127599BF4325C37)


def simhash(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The majority of each bit over the words of each line; ``start`` has the first word of each line (no line is empty)."""
    out = np.empty(len(start), np.uint64)
    ends = np.append(start[1:], len(words))
    lo = 0
    while lo < len(start):  # about 2**15 words at a time: 64 counters a word
        hi = max(lo + 1, int(np.searchsorted(ends, start[lo] + (1 << 15), "right")))
        bits = np.unpackbits(words[start[lo] : ends[hi - 1]].view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, start[lo:hi] - start[lo], axis=0, dtype=np.int32)
        out[lo:hi] = np.packbits(2 * ones > (ends[lo:hi] - start[lo:hi])[:, None], axis=1).view(np.uint64).ravel()
        lo = hi
    return out


def _lines_of(w: Words) -> tuple[np.ndarray, ...]:
    """For every line with a word: document, line number, first word, number of words."""
    breaks = np.flatnonzero(w.data == 10)
    line = np.searchsorted(breaks, w.start) if len(w.start) else np.empty(0, np.int64)  # breaks before the word, in the whole run
    doc = np.repeat(np.arange(w.hi - w.lo), np.diff(w.ptr))
    number = line - np.searchsorted(breaks, w.offsets[:-1])[doc]
    first = np.ones(len(line), bool)
    first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(first)
    return doc[start], number[start], start, np.diff(np.append(start, len(line)))


def _pairs(words: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For every word the hash of it and the word before; a line's first word is paired with its last."""
    before = np.roll(words, 1)
    before[start] = words[np.append(start[1:], len(words)) - 1]
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + words)


def line_classes(docs: DataFrame, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """doc_id, _row, line_no, line_id, bits of every line of at least ``min_words`` words; bits is null under ``fuzzy_words`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer(fold=True)
        for batch in batches:
            for w in tokens.chunks(batch.column(2)):
                doc, number, start, size = _lines_of(w)
                if not len(doc):
                    continue
                place = np.arange(len(w.hash)) - np.repeat(start, size)
                whole = np.add.reduceat(mix(w.hash + mix(place.astype(np.uint64) + np.uint64(0x7F4A7C15))), start)
                whole = mix(whole + size.astype(np.uint64))
                bits = simhash(_pairs(w.hash, start), start)
                keep = size >= min_words
                at = pa.array(w.lo + doc[keep])
                rows = [batch.column(0).take(at), batch.column(1).take(at), pa.array(number[keep].astype(np.int32)), pa.array(whole.view(np.int64)[keep])]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(bits.view(np.int64)[keep], mask=(size < fuzzy_words)[keep])], names=["doc_id", "_row", "line_no", "line_id", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_row", "text").mapInArrow(run, f"doc_id {kind}, _row long, line_no int, line_id long, bits long")


def _words_as_characters(lines: DataFrame) -> DataFrame:
    """``lines`` (line_id, line) with one code point for each word (lower-cased), so that an edit distance of strings is one of words."""
    surrogates, code_points = 0xD800, 0x110000 - 0x800

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer(fold=True)
        for batch in batches:
            for w in tokens.chunks(batch.column(1)):
                code = w.hash % np.uint64(code_points - 32) + np.uint64(32)
                text = np.where(code < surrogates, code, code + np.uint64(0x800)).astype("<u4").tobytes().decode("utf-32-le")
                ends = w.ptr.tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.lo, w.hi - w.lo), pa.array([text[lo:hi] for lo, hi in zip(ends, ends[1:], strict=False)], pa.string())], names=["line_id", "line"])

    return lines.select("line_id", "line").mapInArrow(run, "line_id long, line string")


def _whole(w: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The line_id of every line."""
    place = np.arange(len(w.hash)) - np.repeat(start, size)
    whole = np.add.reduceat(mix(w.hash + mix(place.astype(np.uint64) + np.uint64(0x7F4A7C15))), start)
    return mix(whole + size.astype(np.uint64))


def line_shapes(docs: DataFrame, min_words: int = 1, counted: bool = False) -> DataFrame:
    """doc_id, _row, line_no, line_id, n (words), p0 to p3 (256 parities of words by hash) of every line of at least ``min_words`` words.

    If ``counted``, each task adds its most frequent runs of words as rows without n, with the run as line_id and its number as p0 (see :func:`run_order`), so that words are cut once for both.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("_row", pa.int64()), ("line_no", pa.int32()), ("line_id", pa.int64()), ("n", pa.int32()), *((p, pa.int64()) for p in PARITIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = Tokenizer(fold=True), GramCounts(COMMON)
        for batch in batches:
            for w in tokens.chunks(batch.column(2)):
                doc, number, start, size = _lines_of(w)
                if not len(doc):
                    continue
                if counted:
                    counts.add(_runs(w, start))
                bit, part = np.uint64(1) << (w.hash & np.uint64(63)), w.hash >> np.uint64(6) & np.uint64(3)
                parity = [np.bitwise_xor.reduceat(np.where(part == i, bit, np.uint64(0)), start) for i in range(len(PARITIES))]
                keep = size >= min_words
                numbers = [x.view(np.int64)[keep] for x in (_whole(w, start, size), *parity)]
                columns = [number[keep].astype(np.int32), numbers[0], size[keep].astype(np.int32), *numbers[1:]]
                at = pa.array(w.lo + doc[keep])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c) for c in columns]], names=schema.names)
        value, count = counts.done()
        if len(value):
            given = {"line_id": value.view(np.int64), "p0": count}
            yield pa.RecordBatch.from_arrays([pa.array(given[f.name]) if f.name in given else pa.nulls(len(value), f.type) for f in schema], schema=schema)

    return docs.select("doc_id", "_row", "text").mapInArrow(run, f"doc_id {kind}, _row long, line_no int, line_id long, n int, {', '.join(f'{p} long' for p in PARITIES)}")


def _runs(w: Words, start: np.ndarray) -> np.ndarray:
    """For every word the hash of it and the next two of its line; the line's end counts as a word."""
    last = np.append(start[1:], len(w.hash)) - 1
    total = mix(w.hash * np.uint64(0xE7037ED1A0B428DB))
    following = w.hash
    for _ in range(RUN - 1):
        following = np.append(following[1:], np.uint64(0))
        following[last] = END
        total = mix(total * np.uint64(0xA0761D6478BD642F) + following)
    return total


def run_order(shapes: DataFrame) -> RareFirst:
    """The common runs of all documents, from rows of :func:`line_shapes`."""
    return order_of(shapes.where("n is null").select(F.col("line_id").alias("gram"), F.col("p0").alias("n")))


def most_edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


def spoilt(longest: int, similarity: float) -> np.ndarray:
    """How many runs of a line of so many words the edits to any line in reach can spoil.

    A change or a removal spoils the ``RUN`` runs that a word is in, an insertion one less. A line that is m - n words longer is m - n insertions away at
    least. Lines without any but equal ones in reach have -1.
    """
    out = np.full(longest + 1, -1)
    near = int(1 / (1 - similarity)) + 2  # a line longer by more than this leaves no more edits than a nearer one
    for n in range(1, longest + 1):
        top = int(n / similarity + 1e-9)
        if most_edits(top, similarity):
            out[n] = max(RUN * most_edits(m, similarity) - (m - n) for m in range(n, min(top, n + near) + 1))
    return out


def line_keys(docs: DataFrame, order: RareFirst, similarity: float, fuzzy_words: int, parts: int) -> DataFrame:
    """Keys of lines: lines in reach of each other share one at least. Repeats where a line is repeated.

    Keys are a line's first runs in an order that holds for all lines, rare ones first: one more than the edits within reach can spoil. They come in blocks, so that no row is made of each: (part, keys, ids, spots), ``KEY_BYTES``, eight and two bytes
    a key, all keys of one value in the same of ``parts`` parts. Keys that are known as common are dealt out by their ids too, into as many parts more. A spot is the line's number of words and the
    run's place among them, ``ANY`` for a number that is too large, and for the place of a run that the line has more than once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, most, held, waiting = Tokenizer(fold=True), spoilt(256, similarity), [], 0

        def flush() -> pa.RecordBatch:
            key, ids, spots, common = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            part = np.where(common, parts + (mix(key + ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64), (key % np.uint64(parts)).astype(np.int64)).astype(np.int32)
            by = np.argsort(part, kind="stable")
            part = part[by]
            ends = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            raw, raw_ids = key[by].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes(), ids[by].astype("<i8").tobytes()
            blocks = [pa.array([data[lo * size : hi * size] for lo, hi in zip(ends, ends[1:], strict=False)], pa.binary()) for data, size in ((raw, KEY_BYTES), (raw_ids, 8), (spots[by].tobytes(), 2))]
            return pa.RecordBatch.from_arrays([pa.array(part[ends[:-1]]), *blocks], names=["part", "keys", "ids", "spots"])

        for batch in batches:
            for w in tokens.chunks(batch.column(0)):
                _, _, start, size = _lines_of(w)
                if not len(start):
                    continue
                if size.max() >= len(most):
                    most = spoilt(2 * int(size.max()), similarity)
                whole = _whole(w, start, size)
                once = np.zeros(len(start), bool)
                once[np.unique(whole, return_index=True)[1]] = True
                once &= size >= fuzzy_words
                line = np.repeat(np.arange(len(start)), size)
                mine = np.flatnonzero(once[line])
                line, rank = line[mine], order.rank(_runs(w, start)[mine])
                few = len(start) < 1 << 20  # so that a line's number and most of the rank go into one number to sort by
                by = np.argsort((line.astype(np.uint64) << np.uint64(44)) | rank >> np.uint64(20)) if few else np.lexsort((rank, line))
                spot = mine[by] - start[line[by]]
                line, rank = line[by], rank[by]
                same = (line[1:] == line[:-1]) & (rank[1:] >> np.uint64(20) == rank[:-1] >> np.uint64(20))
                spot[:-1][same] = spot[1:][same] = ANY
                spot = np.minimum(np.stack([size[line], spot], axis=1), ANY).astype(np.uint8)
                first = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else np.empty(0, np.int64)
                place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
                keep = place <= most[size[line]]
                held.append((rank[keep] & np.uint64((1 << 8 * KEY_BYTES) - 1), whole[line[keep]].view(np.int64), spot[keep], rank[keep] >> np.uint64(58) > 0))
                waiting += len(held[-1][0])
                if waiting > 2 * KEYS:
                    yield flush()
                    waiting = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, "part int, keys binary, ids binary, spots binary")


def in_reach(spot_a: np.ndarray, spot_b: np.ndarray, similarity: float) -> np.ndarray:
    """Which lines can be near, by the spots of a run that they share: what stands before it and what follows it must each grow or shrink by edits."""
    n_a, n_b, at_a, at_b = (x.astype(np.int16) for x in (spot_a[:, 0], spot_b[:, 0], spot_a[:, 1], spot_b[:, 1]))
    most = np.floor(np.maximum(n_a, n_b) * (1 - similarity) + 1e-9)
    moved = np.abs(at_a - at_b)
    moved = np.maximum(np.abs(n_a - n_b), np.where(np.maximum(at_a, at_b) == ANY, 0, moved + np.abs(n_a - at_a - n_b + at_b)))
    return np.where(np.maximum(n_a, n_b) == ANY, np.minimum(n_a, n_b) >= ANY * similarity - 1, moved <= most)


def _pairs_of_groups(ids: np.ndarray, spots: np.ndarray, start: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """All pairs (a, b), a < b, within groups of ascending ids that are in reach."""
    found = [np.empty((0, 2), np.int64)]
    for n in np.unique(size).tolist():
        i, j = np.triu_indices(n, 1)
        groups, step = start[size == n], max(1, PAIRS // len(i))
        for lo in range(0, len(groups), step):
            a, b = ((groups[lo : lo + step, None] + x[None, :]).ravel() for x in (i, j))
            near = in_reach(spots[a], spots[b], similarity)
            found.append(np.stack([ids[a[near]], ids[b[near]]], axis=1))
    return np.concatenate(found)


ROW = np.dtype([("key", "<i8"), ("id", "<i8"), ("first", "<i8"), ("size", "<i8"), ("common", "?")])


def block_rows(keys: DataFrame, parts: int, small: int = 0, similarity: float = 0.8) -> DataFrame:
    """What the blocks of :func:`line_keys` hold, staged: for keys of up to ``small`` ids the pairs of ids in reach, once each (a, b, n: by how many keys), else rows (key, id, first, size, common) as
    :func:`~linkloom.llm.components.figures_of_keys` has them.

    Two shuffles of blocks: a part's blocks meet in one task, about ``KEYS`` keys, and equal pairs of all parts meet in another.
    """
    targets = max(1, parts // 8)

    def dealt(rows: np.ndarray, target: np.ndarray) -> list[bytes]:
        by = np.argsort(target, kind="stable")
        ends = np.searchsorted(target[by], np.arange(targets + 1))
        return [rows[by[lo:hi]].tobytes() for lo, hi in zip(ends, ends[1:], strict=False)]

    def group(table: pa.Table) -> pa.Table:
        common = table.column("part")[0].as_py() >= parts
        raw = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint8).reshape(-1, KEY_BYTES)
        key = np.zeros((len(raw), 8), np.uint8)
        key[:, :KEY_BYTES] = raw
        key, ids = key.view("<i8").ravel(), np.frombuffer(b"".join(table.column("ids").to_pylist()), "<i8")
        by = np.argsort(key)
        if not common:
            start = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
            size = np.diff(np.append(start, len(by)))
            by = by[np.repeat(size > 1, size)]
        by = by[np.lexsort((ids[by], key[by]))]
        key, ids = key[by], ids[by]
        pairs = np.empty((0, 2), np.int64)
        if small and not common and len(by):
            spots = np.frombuffer(b"".join(table.column("spots").to_pylist()), np.uint8).reshape(-1, 2)[by]
            once = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])))
            low, high = np.minimum.reduceat(spots, once), np.maximum.reduceat(spots, once)
            spots = np.where(low == high, low, ANY)
            key, ids = key[once], ids[once]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            few = (size > 1) & (size <= small)
            pairs = _pairs_of_groups(ids, spots, start[few], size[few], similarity)
            many = np.repeat(size > small, size)
            key, ids = key[many], ids[many]
        batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(np.full(len(key), common))], names=["key", "id", "common"])
        rows = [np.empty(0, ROW)]
        for found in figures_of_keys(iter([batch])):
            rows.append(np.empty(found.num_rows, ROW))
            for c in ROW.names:
                rows[-1][c] = found.column(c).to_numpy(zero_copy_only=False)
        rows = np.concatenate(rows)
        place = [(mix(x.view(np.uint64) * np.uint64(3) + y.view(np.uint64)) % np.uint64(targets)).astype(np.int64) for x, y in ((pairs[:, 0], pairs[:, 1]), (rows["key"].copy(), rows["id"].copy()))]
        found = pa.table({"target": pa.array(range(targets), pa.int32()), "pairs": pa.array(dealt(pairs, place[0]), pa.binary()), "rows": pa.array(dealt(rows, place[1]), pa.binary())})
        return found.filter(pa.array([len(x) + len(y) > 0 for x, y in zip(found.column("pairs").to_pylist(), found.column("rows").to_pylist(), strict=True)], pa.bool_()))

    def once(table: pa.Table) -> pa.Table:
        pairs = np.frombuffer(b"".join(table.column("pairs").to_pylist()), "<i8").reshape(-1, 2)
        rows = np.frombuffer(b"".join(table.column("rows").to_pylist()), ROW)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        start = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1))) if len(pairs) else np.empty(0, np.int64)
        n, more = len(start), len(rows)
        columns = {"a": pairs[start, 0], "b": pairs[start, 1], "n": np.diff(np.append(start, len(pairs))).astype(np.int64)}
        out = {c: pa.concat_arrays([pa.array(x), pa.nulls(more, pa.int64())]) for c, x in columns.items()}
        return pa.table(out | {c: pa.concat_arrays([pa.nulls(n, pa.bool_() if c == "common" else pa.int64()), pa.array(rows[c])]) for c in ROW.names})

    blocks = keys.groupBy("part").applyInArrow(group, "target int, pairs binary, rows binary")
    return stage(blocks.groupBy("target").applyInArrow(once, "a long, b long, n long, key long, id long, first long, size long, common boolean"))


def groups_of_rows(found: DataFrame) -> DataFrame:
    """(key, id, first, size) of the keys of several ids among the rows of :func:`block_rows`. Of common keys a part has distinct ids;
    their figures come from a grouping that combines in the map tasks."""
    rows = found.where("key is not null")
    common = rows.where("common").select("key", "id")
    whole = common.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    return rows.where("not common").select("key", "id", "first", "size").unionByName(common.join(F.broadcast(whole), "key").select("key", "id", "first", "size"))


def block_groups(keys: DataFrame, parts: int) -> DataFrame:
    """(key, id, first, size) of all keys of several ids, as :func:`~linkloom.llm.components.key_groups` has them, from blocks."""
    return groups_of_rows(block_rows(keys, parts))


def _said(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(line_id, line) of the lines of ``pairs`` (a, b, _row_a, line_no_a, _row_b, line_no_b), a character for each word."""
    needed = pairs.select(F.explode(F.array(*[F.struct(F.col(c).alias("line_id"), F.col(f"_row_{c}").alias("_row"), F.col(f"line_no_{c}").alias("line_no")) for c in "ab"])).alias("x")).select("x.*")
    needed = stage(needed.distinct())
    said = may_contain(docs.select("_row", "text"), needed, "_row").select("_row", F.posexplode(F.split(text_or_empty(), "\n")).alias("line_no", "line"))
    said = may_contain(said, needed, "_row", "line_no").join(needed, ["_row", "line_no"])
    return stage(_words_as_characters(said))


def _verify(pairs: DataFrame, said: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose lines are near enough."""
    pairs = pairs.select("a", "b")
    for c in "ab":
        pairs = pairs.join(said.select(F.col("line_id").alias(c), F.col("line").alias(f"line_{c}")), c)
    pairs = pairs.withColumn("longest", F.greatest(F.length("line_a"), F.length("line_b"))).withColumn("most", F.floor(F.col("longest") * (1 - similarity) + 1e-9).cast("int"))
    # Words of one line that the other doesn't have at all need an edit each: most pairs are told apart by that.
    pairs = pairs.where((F.least(F.length("line_a"), F.length("line_b")) >= F.col("longest") * similarity - 1e-9) & F.expr("length(translate(line_a, line_b, '')) <= most"))
    return pairs.where(F.expr("levenshtein(line_a, line_b, most) >= 0")).select("a", "b")


def near_lines(docs: DataFrame, classes: DataFrame, order: RareFirst, similarity: float, fuzzy_words: int) -> DataFrame:
    """(id, root) of the classes (line_id, first, n_words, p0 to p3) that are linked by edit similarity alone.

    Every class is first compared with the smaller one that it shares most keys with (of a key of many classes, with its smallest one); what isn't connected then is compared with
    all that share a key: pair by pair where a key has few classes, tile by tile where it has many.
    """
    facts = classes.select(F.col("line_id").alias("id"), F.col("n_words").alias("n"), *PARITIES, F.col("first._row").alias("_row"), F.col("first.line_no").alias("line_no"))
    total = classes.agg(F.sum("n_words")).first()[0] or 0
    parts = max(1, total // (2 * KEYS))
    found = block_rows(line_keys(docs, order, similarity, fuzzy_words, parts), parts, components.SMALL, similarity)
    groups = groups_of_rows(found)
    longer = F.greatest("n_a", "n_b")
    edits = F.floor(longer * (1 - similarity) + 1e-9)
    likely = (F.abs(F.col("n_a") - F.col("n_b")) <= edits) & (F.expr(" + ".join(f"bit_count({p}_a ^ {p}_b)" for p in PARITIES)) <= 2 * edits)
    firsts = best_pairs(groups, 1).select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(1).cast("long").alias("shared"))
    pairs = found.where("key is null").select("a", "b", F.col("n").alias("shared")).unionByName(firsts)
    pairs = stage(with_facts(pairs, facts).where(likely).select("a", "b", "shared", "_row_a", "line_no_a", "_row_b", "line_no_b"))
    said = _said(docs, pairs)
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", F.bitwise_not("a"))).alias("a"))
    links = stage(_verify(best, said, similarity))
    roots = stage(connected_components(links))
    ends = [F.coalesce(f"root_{c}", c) for c in "ab"]
    apart = pairs.select("a", "b").distinct()
    for c in "ab":
        apart = apart.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    more = stage(_verify(apart.where(ends[0] != ends[1]), said, similarity))
    if not more.isEmpty():
        links = stage(links.unionByName(more))
        roots = stage(connected_components(links))
    discard(said)
    few = small_pairs(groups, facts.select("id", "n", *PARITIES), roots, likely, 1)
    many = crowded_rows(groups, roots).select(F.col("key").alias("cluster"), "id", "root").join(facts.select("id", "n", *PARITIES), "id")

    def near(tile: pa.Table) -> pa.Table:
        side, root, n = (tile.column(c).to_numpy() for c in ("side", "root", "n"))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else left
        most = np.floor(np.maximum(n[left][:, None], n[right][None, :]) * (1 - similarity) + 1e-9)
        turned = sum(np.bitwise_count(p[left][:, None] ^ p[right][None, :]).astype(np.int32) for p in (tile.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in PARITIES))
        x, y = np.nonzero((np.abs(n[left][:, None] - n[right][None, :]) <= most) & (turned <= 2 * most) & (root[left][:, None] != root[right][None, :]))
        if left is right:
            x, y = x[x < y], y[x < y]
        ids = tile.column("id").to_numpy()
        return pa.table({"a": np.minimum(ids[left[x]], ids[right[y]]), "b": np.maximum(ids[left[x]], ids[right[y]])})

    crowded = few.unionByName(tile_pairs(stage(many)).groupBy("cluster", "i", "j").applyInArrow(near, "a long, b long"))
    crowded = stage(crowded.distinct())
    if crowded.isEmpty():
        return roots
    crowded = stage(with_facts(crowded, facts.select("id", "_row", "line_no")))
    more = stage(_verify(crowded, _said(docs, crowded), similarity))
    return roots if more.isEmpty() else connected_components(links.unionByName(more))


def repeated_lines(docs: DataFrame, similarity: float = 0.8, bits: int | None = 3, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """(_row, line_no) of the lines that repeat an earlier one, in the sense above, of ``docs`` with _row (see :func:`row_key`); ``bits`` None leaves it to the edit similarity alone."""
    if bits is None:
        if similarity < 0.8:
            raise ValueError("lines share runs for sure only from a similarity of 0.8 on")
        shapes = stage(line_shapes(docs, min_words, counted=True))
        lines = shapes.where("n is not null")
        first = F.min(F.struct("doc_id", "_row", "line_no")).alias("first")
        classes = stage(lines.groupBy("line_id").agg(first, F.count("*").alias("n"), F.first("n").alias("n_words"), *[F.first(p).alias(p) for p in PARITIES]))
        return _later(lines, classes, near_lines(docs, classes, run_order(shapes), similarity, max(min_words, fuzzy_words)))
    if bits > 3:
        raise ValueError("three of six blocks agree only up to 3 bits")
    lines = stage(line_classes(docs, min_words, fuzzy_words))
    first = F.min(F.struct("doc_id", "_row", "line_no")).alias("first")
    classes = stage(lines.groupBy("line_id").agg(first, F.count("*").alias("n"), F.first("bits").alias("bits")))
    block = [f"(shiftrightunsigned(bits, {at}) & {(1 << width) - 1})" for at, width in BLOCKS]
    key = F.explode(F.array(*[F.xxhash64(F.lit(k), *[F.expr(block[i]) for i in three]) for k, three in enumerate(combinations(range(6), 3))]))
    keys = classes.where("bits is not null").select(key.alias("key"), F.col("line_id").alias("id"))
    facts = classes.select(F.col("line_id").alias("id"), "bits", F.col("first._row").alias("_row"), F.col("first.line_no").alias("line_no"))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where(f"bit_count(bits_a ^ bits_b) <= {bits}")
        return _verify(pairs, _said(docs, pairs), similarity)

    def cross(members: DataFrame) -> DataFrame:
        rows = tile_pairs(members)

        def near(tile: pa.Table) -> pa.Table:
            side, root = tile.column("side").to_numpy(), tile.column("root").to_numpy()
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if side.any() else left
            sign = tile.column("bits").to_numpy().astype(np.int64).view(np.uint64)
            x, y = np.nonzero((np.bitwise_count(sign[left][:, None] ^ sign[right][None, :]) <= bits) & (root[left][:, None] != root[right][None, :]))
            if left is right:
                x, y = x[x < y], y[x < y]
            found = {}
            for c, at in (("a", left[x]), ("b", right[y])):
                at = pa.array(at)
                found |= {c: tile.column("id").take(at)} | {f"{f}_{c}": tile.column(f).take(at) for f in ("bits", "_row", "line_no")}
            return pa.table(found)

        sides = ", ".join(f"{c} long, bits_{c} long, _row_{c} long, line_no_{c} int" for c in "ab")
        return verify(stage(rows.groupBy("cluster", "i", "j").applyInArrow(near, sides)))

    roots = link_components(key_groups(keys.withColumn("common", F.lit(False))), facts, verify, cross, F.expr(f"bit_count(bits_a ^ bits_b) <= {bits}"), agree=1)
    return _later(lines, classes, roots)


def _later(lines: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(_row, line_no) of all lines but the first of each root."""
    roots = roots.withColumnRenamed("id", "line_id")
    several = flagged(classes.select("line_id", "first", "n"), roots, "line_id").where("n > 1 or _maybe").join(roots, "line_id", "left").where("n > 1 or root is not null")
    several = stage(several.select("line_id", "first", F.coalesce("root", "line_id").alias("root")))
    kept = stage(several.join(several.groupBy("root").agg(F.min("first").alias("kept")), "root").select("line_id", "kept"))
    again = may_contain(lines.select("doc_id", "_row", "line_no", "line_id"), kept, "line_id").join(kept, "line_id")
    return again.where("not (doc_id <=> kept.doc_id and _row = kept._row and line_no = kept.line_no)").select("_row", "line_no")


def row_key():
    """What a row is known by: doc_id and text. Rows that share both are told apart only when all else is done, see :func:`dedup_lines`."""
    return F.xxhash64("doc_id", "text")


def _one_of_equal_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with _kept, in two: rows whose _row no other row has (surely), and the others, written once, of which one of each doc_id and text is kept."""
    again = docs.groupBy("_row").agg(F.count("*").alias("_n")).where("_n > 1").select("_row")
    maybe, single = split_by(docs, again, "_row")
    numbered = stage(maybe.withColumn("_place", F.monotonically_increasing_id()))
    first = numbered.groupBy(F.col("_row").alias("_key"), F.col("doc_id").alias("_id")).agg(F.min("_place").alias("_first"))
    same = F.expr("_row = _key and doc_id <=> _id")
    told = numbered.join(first, same).select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("_place") == F.col("_first")).alias("_kept"))
    return single.withColumn("_kept", F.lit(True)), told


def dedup_lines(docs: DataFrame, similarity: float = 0.8, bits: int | None = 3, min_words: int = MIN_WORDS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """``docs`` with the repeated lines cut out of text, and n_lines, n_removed, emptied added.

    Lines are split at ``\\n``; lines of fewer than ``min_words`` words stay always, lines of fewer than ``fuzzy_words`` go only for an equal one.
    emptied is true where lines were removed and no word is left. Null and empty texts stay as they are (n_lines 0 and 1). Lines repeated
    within a document count too. A row is known by doc_id and text, so that rows that share a doc_id, or have none, lose their own lines only; of rows that share both, one keeps what it has first and
    the others lose every line of at least ``min_words`` words. Null doc_id come first. Other columns pass through; those named like the new ones are replaced.
    """
    added = ["n_lines", "n_removed", "emptied"]
    names = [c for c in docs.columns if c not in added]
    other = [c for c in names if c not in ("doc_id", "text")]
    docs = docs.select("doc_id", "text", row_key().alias("_row"), *([F.struct(*[F.col(f"`{c}`") for c in other]).alias("rest")] if other else []))
    gone = stage(repeated_lines(docs, similarity, bits, min_words, fuzzy_words).distinct())
    single, equal = _one_of_equal_rows(docs)
    docs = single.unionByName(equal)
    maybe, whole = split_by(docs, gone.select("_row"), "_row")
    gone = gone.groupBy("_row").agg(F.collect_list("line_no").alias("_gone"))
    touched = maybe.join(gone, "_row", "left")
    out = touched.unionByName(whole.withColumn("_gone", F.lit(None).cast("array<int>"))).withColumn("_lines", F.split("text", "\n"))
    every = F.filter(F.transform("_lines", lambda x, i: F.when(count_words(x) >= min_words, i)), lambda i: i.isNotNull())
    out = out.withColumn("_gone", F.when(F.col("_kept"), F.col("_gone")).otherwise(F.when(F.size(every) > 0, every)))
    left = F.filter("_lines", lambda x, i: ~F.array_contains("_gone", i))
    out = out.withColumn("text", F.when(F.col("_gone").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text")))
    removed = F.greatest(F.lit(0), F.coalesce(F.size("_gone"), F.lit(0))).cast("long")
    return out.select(
        *[F.col("rest").getField(c).alias(c) if c in other else F.col(c) for c in names],
        F.greatest(F.lit(0), F.coalesce(F.size("_lines"), F.lit(0))).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), F.lit(0).cast("long")).otherwise(removed).alias("n_removed"),
        (F.col("_gone").isNotNull() & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("emptied"),
    )
