"""Phrase collocation mining by dynamic itemset counting.

Texts are cut into words once; words become 64-bit numbers (language and word together; a vocabulary of all words shows that no two share one), written as
shards. The shards are scanned in a cycle, one Spark job each. Single words are counted from the first scan on; a longer phrase is counted from the scan after both
its subphrases (without its last, without its first word) have reached the threshold in what has been counted so far, whatever the place in the cycle, until its own
cycle is full. The scans end when a whole cycle has activated nothing.

Active phrases are told to the tasks as bitmaps of fixed size. A bit that is set by chance only activates a phrase that need not be; as bits are never taken back
and decide alone, every phrase is counted on each shard once or never, and counts are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import may_contain, shared_dir, stage, text_or_empty
from .textvec import Tokenizer, mix

SHARDS = 4
THRESHOLD = 10
LONGEST = 3
CONTAINED = 50  # per cent of a phrase's count that a longer one's must reach to drop it
TOP = 2000
CHUNK = 1 << 19  # bytes of text that become one row of a shard
BITS = 24  # of a bitmap, 2 MB
FLUSH = 1 << 20
_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _word_keys(text_hash: np.ndarray, lang_hash: np.ndarray) -> np.ndarray:
    return np.maximum(mix(text_hash + lang_hash), np.uint64(1))  # 0 stands between pieces


def _lang_hash(lang: str) -> int:
    return int.from_bytes(blake2b(lang.encode(), digest_size=8).digest(), "little")


def numbered(docs: DataFrame, shards: int, chunk: int, salt: int) -> DataFrame:
    """Rows of three kinds: shards of words (shard, words: 64-bit numbers in text order, 0 between pieces), the vocabulary (shard -1, key, lang, word) and
    languages' numbers of words (shard -1, lang, n). A task names a word once."""
    kind = "shard int, words binary, key long, lang string, word string, n long"
    given = docs.select(text_or_empty().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.spark_partition_id().alias("part"))

    def words_of(run, lang: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the words, and the same with 0 where a piece ends."""
        keys = _word_keys(run.hash, np.repeat(lang, np.diff(run.ptr)))
        cut = np.zeros(len(keys), bool)
        cut[:-1] = breaks[run.start[1:]] > breaks[run.end[:-1]]
        cut[run.ptr[1:-1][(run.ptr[1:-1] > 0)] - 1] = True
        cut[-1:] = True
        return keys, np.insert(keys, np.flatnonzero(cut) + 1, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(fold=True)
        tokenizer.space[:] = False
        tokenizer.space[[0x20, 0x09, *_BREAKS]] = True
        tokenizer.code = mix(tokenizer.code + np.uint64(salt))
        is_break = np.zeros(256, np.int64)
        is_break[list(_BREAKS)] = 1
        seen, place, totals = np.empty(0, np.uint64), None, {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            hashes = np.array([_lang_hash(x) for x in names], np.uint64)
            if place is None:
                place = batch.column("part")[0].as_py()
            for part in tokenizer.chunks(batch.column("text"), chunk):
                if not len(part.start):
                    continue
                here = codes[part.lo : part.hi]
                keys, line = words_of(part, hashes[here], np.concatenate([[0], np.cumsum(is_break[part.data])]))
                for name, n in zip(names, np.bincount(here, np.diff(part.ptr), len(names)).astype(np.int64).tolist(), strict=True):
                    totals[name] = totals.get(name, 0) + n
                fresh, at = np.unique(keys, return_index=True)
                new = ~np.isin(fresh, seen, assume_unique=True)
                fresh, at = fresh[new], at[new]
                seen = np.sort(np.concatenate([seen if len(seen) < 1 << 22 else seen[:0], fresh]))
                raw, doc = part.data.tobytes().lower(), np.searchsorted(part.ptr, at, "right") - 1
                spelled = [raw[s:e] for s, e in zip(part.start[at].tolist(), part.end[at].tolist(), strict=True)]
                ends = np.flatnonzero(line == 0) + 1
                rows, lo = [], 0
                while lo < len(line):  # a very long text becomes several rows, cut between pieces
                    hi = int(ends[min(np.searchsorted(ends, lo + max(chunk, 1 << 17)), len(ends) - 1)])
                    rows.append(line[lo:hi].astype("<u8").tobytes())
                    lo = hi
                none = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([(place + np.arange(none)) % shards, np.full(len(fresh), -1)]).astype(np.int32)),
                        pa.array([*rows, *[None] * len(fresh)], pa.binary()),
                        pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(fresh.view(np.int64))]),
                        pa.concat_arrays([pa.nulls(none, pa.string()), pa.array(names, pa.string()).take(pa.array(here[doc]))]),
                        pa.concat_arrays([pa.nulls(none, pa.string()), pa.array(spelled, pa.binary()).cast(pa.string())]),
                        pa.nulls(none + len(fresh), pa.int64()),
                    ],
                    names=["shard", "words", "key", "lang", "word", "n"],
                )
                place += none
        rows = [(-1, None, None, lang, None, n) for lang, n in totals.items()]
        kinds = [pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["shard", "words", "key", "lang", "word", "n"])

    return given.mapInArrow(run, kind)


def _written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` in the shared folder, a folder for each value of ``by``."""
    path = f"{shared_dir(df.sparkSession)}/linkloom-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _gram_keys(columns: list[np.ndarray]) -> np.ndarray:
    total = np.full(len(columns[0]), len(columns), np.uint64)
    for i, c in enumerate(columns):
        total = mix(total * _K[i % 4] + c)
    return total


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys & np.uint64((1 << BITS) - 1), keys >> np.uint64(64 - BITS)


def _probe(bitmap: np.ndarray | None, columns: list[np.ndarray]) -> np.ndarray:
    if bitmap is None:
        return np.zeros(len(columns[0]), bool)
    out = np.ones(len(columns[0]), bool)
    for place in _places(_gram_keys(columns)):
        out &= (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def _bitmap(phrases: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_numpy().view(np.uint64) for i in range(size)]
            place = np.concatenate(_places(_gram_keys(columns)))
            mask = np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).view(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    bits = phrases.select(*_columns(size)).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[bits.column("word").to_numpy().astype(np.int64)] = bits.column("mask").to_numpy().astype(np.int64).view(np.uint64)
    return out


def _columns(size: int) -> list[str]:
    return [f"w{i + 1}" for i in range(size)]


def _counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns`` and how often each comes."""
    keys = _gram_keys(columns)
    order = np.argsort(keys)
    keys, columns = keys[order], [c[order] for c in columns]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if any((c[1:] != c[:-1])[~new[1:]].any() for c in columns):  # different rows, one key
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    first = np.flatnonzero(new)
    return [c[first] for c in columns], np.diff(first, append=len(keys))


def scan(shard: DataFrame, first_cycle: bool, now: dict, before: dict, longest: int) -> DataFrame:
    """Counts of the active phrases of one shard that weren't active when it was scanned last: size, w1 .. , n. ``now`` and ``before`` are bitmaps by size (broadcast)."""
    names = ["size", *_columns(longest), "n"]

    def starts(bitmaps: dict, line: np.ndarray) -> list[np.ndarray]:
        """Where an active phrase of 2 .. longest words begins."""
        out, held = [], (line != 0) & _probe(bitmaps.get(1), [line])
        for size in range(2, longest + 1):
            active = held[:-1] & held[1:]
            out.append(active)
            if size < longest:
                at = np.flatnonzero(active)
                held = np.zeros(len(active), bool)
                held[at] = _probe(bitmaps.get(size), [line[at + i] for i in range(size)])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, sent_before = ({k: b.value for k, b in x.items()} for x in (now, before))
        held: dict[int, list] = {size: [] for size in range(1, longest + 1)}
        waiting = dict.fromkeys(held, 0)

        def flush(size: int) -> Iterator[pa.RecordBatch]:
            if waiting[size]:
                columns, n = _counted([np.concatenate(c) for c in zip(*held[size], strict=True)])
                held[size], waiting[size] = [], 0
                full = [pa.array(c.view(np.int64)) for c in columns] + [pa.array(np.zeros(len(n), np.int64))] * (longest - size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), size, np.int32)), *full, pa.array(n.astype(np.int64))], names=names)

        for batch in batches:
            for row in batch.column(0):
                line = np.frombuffer(row.as_buffer(), "<u8")
                found = [(1, [line[line != 0]])] if first_cycle else []
                earlier = starts(sent_before, line) if sent_before else [None] * (longest - 1)
                for size, (active, old) in enumerate(zip(starts(sent, line), earlier, strict=True), 2):
                    at = np.flatnonzero(active if old is None else active & ~old)
                    found.append((size, [line[at + i] for i in range(size)]))
                for size, columns in found:
                    if len(columns[0]):
                        held[size].append(columns)
                        waiting[size] += len(columns[0])
                    if waiting[size] > FLUSH:
                        yield from flush(size)
        for size in held:
            yield from flush(size)

    kind = ", ".join(["size int", *(f"{c} long" for c in _columns(longest)), "n long"])
    keys = ["size", *_columns(longest)]
    return shard.select("words").mapInArrow(run, kind).groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, "n")



def least_heavy(threshold: int, shards: int) -> int:
    """A phrase that reaches the threshold over all shards has this count in one of them at least."""
    return -(-threshold // shards)


def frequent(scans: list[DataFrame], size: int, threshold: int, exact: bool = True) -> DataFrame:
    """Phrases of ``size`` words whose counts over ``scans`` add up to the threshold: w1 .., f. Only phrases with a heavy count in some scan (see :func:`least_heavy`) can; if not ``exact``
    only their heavy counts are added, which reads far less and may find a phrase later than it could be."""
    keys = _columns(size)
    every = None
    for part in scans:
        part = part.where(F.col("size") == size)
        every = part if every is None else every.union(part)
    heavy = every.where("heavy").select(*keys, "n")
    if exact and len(scans) > 1:
        heavy = may_contain(every.select(*keys, "n"), heavy.select(*keys), *keys)
    return heavy.groupBy(*keys).agg(F.sum("n").alias("f")).where(F.col("f") >= threshold)


def count_phrases(spark: SparkSession, lines: DataFrame, longest: int, threshold: int, shards: int) -> dict[int, DataFrame]:
    """By number of words: all phrases with at least ``threshold`` occurrences, w1 .., f.

    Within a cycle heavy counts activate; at its end the exact sums do, so that nothing is missed."""
    scans: list[tuple[range, DataFrame]] = []  # sizes that a scan may have counted, its counts
    history: list[dict[int, np.ndarray]] = [{}]
    sent: list[dict] = [{}]
    sums: dict[int, tuple[int, DataFrame]] = {}  # by size, how many scans had counted it when its exact sums were made, and these
    while True:
        t = len(scans)
        if t >= shards and history[t].keys() == history[t - shards].keys() and all(np.array_equal(history[t][k], history[t - shards][k]) for k in history[t]):
            break
        sizes = range(1 if t < shards else 2, min(longest, max(history[t], default=0) + 1) + 1)
        counts = scan(lines.where(F.col("shard") == t % shards), t < shards, sent[t], sent[t - shards] if t >= shards else {}, longest)
        scans.append((sizes, _written(counts.withColumn("heavy", F.col("n") >= least_heavy(threshold, shards)), "size", "heavy")))
        after, held = dict(history[t]), dict(sent[t])
        for size in sizes:
            if size < longest:
                parts, exact = [s for counted, s in scans if size in counted], t % shards == shards - 1
                phrases = frequent(parts, size, threshold, exact)
                if exact:
                    phrases = stage(phrases)
                    sums[size] = len(parts), phrases
                bits = _bitmap(phrases, size)
                if size in after:
                    bits |= after[size]
                if bits.any() and not (size in after and np.array_equal(bits, after[size])):
                    after[size], held[size] = bits, spark.sparkContext.broadcast(bits)
        history.append(after)
        sent.append(held)
        if t >= shards:  # nothing asks for these any more
            for size, old in sent[t - shards].items():
                if old is not sent[t - shards + 1].get(size):
                    old.unpersist()
            history[t - shards] = sent[t - shards] = {}
    found = {}
    for size in range(1, longest + 1):
        parts = [s for sizes, s in scans if size in sizes]
        if parts and sums.get(size, (0, None))[0] == len(parts):
            found[size] = sums[size][1]
            continue
        found[size] = stage(frequent(parts, size, threshold)) if parts else spark.createDataFrame([], ", ".join([*(f"{c} long" for c in _columns(size)), "f long"]))
    return found


def _phrase(first: int, size: int, alias: str, table: DataFrame) -> DataFrame:
    """``table`` for a join on words ``first`` .. of a longer phrase, its count as ``alias``."""
    return table.select(*[F.col(f"w{i + 1}").alias(f"w{first + i}") for i in range(size)], F.col("f").alias(alias))


def mine_phrases(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, contained: int = CONTAINED, top: int = TOP, shards: int = SHARDS, chunk: int = CHUNK) -> DataFrame:
    """For each lang the first ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has text and lang (null texts are empty, null langs are ``und``); other columns, whatever their names, are not read. A-Z are lowered; phrases don't cross ``.,;:!?`` or line ends.
    Every occurrence counts, repeated rows and overlaps too. A phrase's score is its lowest over all cuts, floor(1000000 a a / (l r)), ties to the first cut; phrases of which a
    longer one with ``contained`` per cent of their count exists are dropped. Ties in score go by count, then by phrase in UTF-8 byte order. An empty table has no rows.
    """
    spark = docs.sparkSession
    for salt in range(1, 9):
        rows = _written(numbered(docs, shards, chunk, salt), "shard")
        names = rows.where(F.col("shard") == -1)
        vocabulary = stage(names.where(F.col("key").isNotNull()).select("key", "lang", "word").distinct())
        if vocabulary.groupBy("key").count().where("count > 1").isEmpty():
            break
    else:
        raise ArithmeticError("words share a number under every salt")
    totals = names.where(F.col("key").isNull()).groupBy("lang").agg(F.sum("n").alias("n"))
    found = count_phrases(spark, rows, longest, threshold, shards)
    words = stage(found[1].join(vocabulary.withColumnRenamed("key", "w1"), "w1"))
    out = None
    for size in range(2, longest + 1):
        keys = _columns(size)
        phrases = found[size].withColumnRenamed("f", "a")
        for i in range(1, size + 1):
            kept = [F.col("w1").alias(f"w{i}"), F.col("f").alias(f"f{i}_1"), F.col("word").alias(f"word{i}")]
            phrases = phrases.join(words.select(*kept, *(["lang"] if i == 1 else [])), f"w{i}")
        for length in range(2, size):
            for first in sorted({1, size - length + 1}):
                phrases = phrases.join(_phrase(first, length, f"f{first}_{length}", found[length]), [f"w{first + i}" for i in range(length)])
        cuts = []
        for k in range(1, size):
            a, l, r = (F.col(c).cast("decimal(18,0)") for c in ("a", f"f1_{k}", f"f{k + 1}_{size - k}"))
            phrases = phrases.withColumn(f"_top{k}", F.lit(1000000).cast("decimal(7,0)") * (a * a).cast("decimal(31,0)")).withColumn(f"_under{k}", (l * r).cast("decimal(36,0)"))
            cuts.append(F.struct(F.expr(f"_top{k} div _under{k}").alias("score"), F.lit(k).alias("k"), F.col(f"f1_{k}").alias("l"), F.col(f"f{k + 1}_{size - k}").alias("r")))
        phrases = phrases.withColumn("_cut", F.array_min(F.array(*cuts)))
        within = None
        for longer in range(size + 1, longest + 1):
            for first in range(1, longer - size + 2):
                part = found[longer].select(*[F.col(f"w{first + i}").alias(f"w{i + 1}") for i in range(size)], F.col("f").alias("_f"))
                within = part if within is None else within.union(part)
        if within is not None:
            phrases = phrases.join(within.groupBy(*keys).agg(F.max("_f").alias("_f")), keys, "left").where(f"_f is null or 100 * _f < {contained} * a")
        part = phrases.select("lang", F.concat_ws(" ", *[f"word{i}" for i in range(1, size + 1)]).alias("phrase"), "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), F.col("_cut.score").alias("score"))
        out = part if out is None else out.union(part)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
