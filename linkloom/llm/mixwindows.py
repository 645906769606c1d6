"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed number of tokens.

In each round every source's queue is granted its share of a window's tokens; it gives pieces as long as its credit lasts and carries what is left over. A queue
that has been granted r shares and never more than it holds has given all pieces that end within r shares, so a piece's round follows from the running sum
of its source's tokens alone, and the whole schedule is an order: round, source, place in the queue. Running sums along that order, in two steps each (sums
of blocks, then within a block), carry deficits and windows' ends across partitions; only sizes are shuffled for them. Windows are cut where they
are full, so that only the last is padded.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, text_or_empty

WINDOW = 4096
PIECE = 1024  # longest run of a document that a queue gives at once
END_ID = 2
SLICE = 1 << 23  # characters of text that are encoded at once
KNOWN_WORDS, KNOWN_CHARS = 400_000, 16_000_000
BLOCK_ROWS, BLOCKS = 500, 4096


class Encoder:
    """Ids of texts by a tokenizer, every word encoded once and then known.

    A text is cut at white space, and between a letter a-z and the punctuation after it, where a tokenizer that parts words never joins; A-Z are lowered first if the
    tokenizer does so itself and no mark follows them that could join them. Normal lower-case words of letters go to the tokenizer's model without its normaliser and splitter, which leave them alone.
    A tokenizer that treats a probe of such cases otherwise encodes whole texts instead."""

    PROBE = ("Don't stop, it's 2024; (x) a.b.c? Well... 'tis", "Ünder é\u0301 H\u0331a <|x|> ÀB, ça.", "a", "", " \t b\n", "straße ünder façon año")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = getattr(self.plain.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        self.ends = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.lowers = self._whole(["AbC"]) == self._whole(["abc"])
        self._forget()
        self.parts = True
        found, counts = self.encode(pa.array(self.PROBE, pa.large_string()))
        expected = self._whole(list(self.PROBE))
        self.parts = counts.tolist() == [len(x) for x in expected] and found.tolist() == [i for x in expected for i in x]

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.known, self.chars = {}, 0
        self.count, self.start, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        return array if n <= len(array) else np.concatenate([array, np.zeros(max(n - len(array), len(array)), array.dtype)])

    def _add(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        self.count, self.start, self.flat = self._room(self.count, n + len(words)), self._room(self.start, n + len(words)), self._room(self.flat, self.used + len(ids))
        self.count[n : n + len(words)] = counts
        self.start[n : n + len(words)] = self.used + np.cumsum(counts) - counts
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + len(words)), strict=True))
        self.chars += sum(map(len, words))

    def _learn(self, words: list[str]) -> None:
        simple = [w for w in words if w.isalpha() and w == w.lower() and (w.isascii() or is_normalized("NFC", w))] if len(self.ends) else []
        groups = [simple[i : i + 1000] for i in range(0, len(simple), 1000)]
        for group, found in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            self._add(group, ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1))
        if len(simple) < len(words):
            others = [w for w in words if w not in self.known]
            found = self._whole(others)
            self._add(others, np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and how many each has."""
        if not self.parts:
            found = self._whole(texts.to_pylist())
            return np.fromiter((i for ids in found for i in ids), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        if len(self.known) > KNOWN_WORDS or self.chars > KNOWN_CHARS:
            self._forget()
        if self.lowers and not pc.any(pc.match_substring_regex(texts, r"[A-Z]\p{M}|<\|")).as_py():
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([a-z])([.,;:!?])", r"\1 \2"))
        ends = np.asarray(words.offsets)
        coded = words.flatten().dictionary_encode()
        values = coded.dictionary.to_pylist()
        self._learn([v for v in values if v not in self.known])
        place = np.fromiter((self.known[v] for v in values), np.int64, len(values))[coded.indices.to_numpy()] if values else np.empty(0, np.int64)
        counts = self.count[place]
        before = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(self.start[place] - before[:-1], counts) + np.arange(before[-1])
        return self.flat[at], np.diff(before[ends])


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    ends, lo = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, hi
        lo = hi


def _pieces_of(counts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each piece: the document's place, where it starts in the document, how long it is."""
    n = -(-counts // longest)
    doc = np.repeat(np.arange(len(counts)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * longest
    return doc, start, np.minimum(counts[doc] - start, longest)


def tokenized(docs: DataFrame, path: str, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """The documents' ids, ``end_id`` last, as pieces of at most ``piece``: _row, _hash, doc_id, _source, start, length, doc_tokens, _ids (16-bit little-endian, or 32-bit
    for ids that need it). _row tells repeated rows apart."""
    given = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.xxhash64("doc_id", "source", text_or_empty()).alias("_hash"),
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_source"),
        text_or_empty().alias("_text"),
    )
    kept = ["_row", "_hash", "doc_id", "_source"]
    names = [*kept, "start", "length", "doc_tokens", "_wide", "_ids"]
    out = given.select(*kept).withColumns({"start": F.lit(0).cast("long"), "length": F.lit(0).cast("long"), "doc_tokens": F.lit(0).cast("long"), "_wide": F.lit(False), "_ids": F.lit(b"")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = batch.column("_text").cast(pa.large_string())
            for lo, hi in _slices(texts):
                ids, counts = encoder.encode(texts[lo:hi])
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                doc, start, length = _pieces_of(counts, piece)
                wide = bool(ids.max() >> 16)
                size = 4 if wide else 2
                ends = np.concatenate([[0], np.cumsum(length)]) * size
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4" if wide else "<u2"))])
                at = pa.array(doc + lo)
                arrays = [*(batch.column(c).take(at) for c in kept), pa.array(start), pa.array(length), pa.array(counts[doc]), pa.array(np.full(len(doc), wide)), raw.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return given.mapInArrow(run, out.schema)


def running(df: DataFrame, block: str, group: list[str], order: list, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows of the same ``group`` before this one, in the order of ``block``, then ``order``.

    Blocks are summed first, so that a group may be of any size; a group has ``BLOCKS`` blocks at most."""
    sums = df.groupBy(*group, block).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(*group, block, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*group, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = inner.join(first if group else F.broadcast(first), [*group, block])
    return joined.withColumn(name, F.col("_inner") + F.col("_first")).drop("_inner", "_first")


def schedule(pieces: DataFrame, window: int = WINDOW, weights: DataFrame | None = None) -> DataFrame:
    """Where every piece (_row, _hash, _source, start, length) goes: _at, its place among all tokens of the deficit round-robin."""
    totals = pieces.groupBy("_source").agg(F.sum("length").alias("_tokens"), F.count("*").alias("_rows"))
    if weights is None:
        wanted = totals.withColumn("_weight", F.col("_tokens").cast("double"))
    else:
        given = weights.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_source"), F.col("weight").cast("double").alias("_weight"))
        wanted = totals.join(given, "_source")
    whole = wanted.agg(F.sum("_weight").alias("w"), F.sum("_tokens").alias("t"), F.sum("_rows").alias("n")).first()
    if not whole["n"]:
        return pieces.withColumn("_at", F.lit(0).cast("long"))
    blocks = max(1, min(BLOCKS, whole["n"] // BLOCK_ROWS))
    queued = pieces.withColumn("_block", F.pmod(F.shiftright("_hash", 40), F.lit(blocks)))
    queued = running(queued, "_block", ["_source"], ["_hash", "_row", "start"], "length", "_before").join(wanted.select("_source", (F.lit(float(window)) * F.col("_weight") / F.lit(whole["w"])).alias("_grant")), "_source")
    dealt = queued.withColumn("_round", F.ceil((F.col("_before") + F.col("length")) / F.col("_grant")).cast("long"))
    last = dealt.agg(F.max("_round")).first()[0]
    ordered = dealt.withColumn("_block", F.floor((F.col("_round") * F.lit(float(blocks)) / F.lit(last + 1))).cast("long"))
    return running(ordered, "_block", [], ["_round", "_source", "_before"], "length", "_at")


def pack_windows(docs: DataFrame, path: str, window: int = WINDOW, piece: int = PIECE, end_id: int = END_ID, weights: DataFrame | None = None) -> DataFrame:
    """One row per run of a document in a window: doc_id, start, length, doc_tokens, sequence_id, offset, source, ids (32-bit little-endian, unsigned).

    ``docs`` has doc_id, text and source (null texts are empty: only ``end_id``; null sources are one source); other columns, whatever their names, are not read. Every id lies in
    one run, repeated rows have runs of their own, and an empty table has none. A source's share of a window is its share of all tokens, the one target that every
    window can meet when all is packed; up to a piece a source may be carried over. ``weights`` (source, weight) asks for other shares: then only these sources are
    packed, and windows have what is left once a queue is empty. The order of a queue follows a hash of the row, so that reruns agree but for equal rows.
    """
    pieces = stage(tokenized(docs, path, min(piece, window), end_id))
    placed = stage(schedule(pieces.select("_row", "_hash", "_source", "start", "length"), window, weights).select("_row", "start", "length", "_at"))
    first, last = F.expr(f"_at div {window}"), F.expr(f"(_at + length - 1) div {window}")
    runs = placed.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("_at"), F.col("sequence_id") * window)
    high = F.least(F.col("_at") + F.col("length"), (F.col("sequence_id") + 1) * window)
    runs = runs.select("_row", "start", "sequence_id", (low - F.col("sequence_id") * window).alias("offset"), (low - F.col("_at")).alias("_skip"), (high - low).alias("_length"))
    size = F.when(F.col("_wide"), 4).otherwise(2)
    cut = F.expr("substring(_ids, cast(_skip * _size + 1 as int), cast(_length * _size as int))")
    joined = pieces.select("_row", "start", "doc_id", F.col("_source"), "doc_tokens", "_wide", size.alias("_size"), "_ids").join(runs, ["_row", "start"])
    out = joined.select(
        "doc_id",
        (F.col("start") + F.col("_skip")).alias("start"),
        F.col("_length").alias("length"),
        "doc_tokens",
        "sequence_id",
        "offset",
        F.when(F.col("_source") != "n", F.expr("substring(_source, 2)")).alias("source"),
        "_wide",
        cut.alias("ids"),
    )
    names = [c for c in out.columns if c != "_wide"]

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wide, column = batch.column("_wide").to_numpy(zero_copy_only=False), batch.column("ids").cast(pa.large_binary())
            if not wide.all():
                if wide.any():
                    column = pa.array([v if w else np.frombuffer(v, "<u2").astype("<u4").tobytes() for v, w in zip(column.to_pylist(), wide, strict=True)], pa.large_binary())
                else:
                    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view("<u2").astype("<u4")
                    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer((ends - ends[0]) * 2), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([column.cast(pa.binary()) if c == "ids" else batch.column(c) for c in names], names=names)

    return out.mapInArrow(widen, out.select(*names).schema)
