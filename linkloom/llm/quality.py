"""Quality rules: counts of whole texts, then a hashed n-gram log-likelihood ratio between trusted and raw text.

Words, word pairs and runs of four bytes are hashed into a fixed number of buckets. Their counts over the trusted documents and over
all documents are two multinomials, both smoothed by the same number of pseudo-counts, and a document's score is the mean of the log
ratio over its n-grams. A fixed threshold decides every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sieve, passing, stage
from .textvec import Tokenizer, Words, mix

BUCKETS = 1 << 17
PRIOR = 200.0
THRESHOLD = -0.25
SYMBOLS = b"#*$%&|<>"


def features(w: Words, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of a run: words, word pairs and four-byte runs inside a document."""
    docs = len(w.ptr) - 1
    of_word = np.repeat(np.arange(docs), np.diff(w.ptr))
    same = of_word[1:] == of_word[:-1]
    pair = mix(w.hash[:-1] * np.uint64(0xD6E8FEB86659FD93) + w.hash[1:])[same]
    n = len(w.data)
    quad = np.empty(0, np.uint64)
    of_quad = np.empty(0, np.int64)
    if n >= 4:
        d = w.data.astype(np.uint32)
        code = d[:-3] | d[1:-2] << 8 | d[2:-1] << 16 | d[3:] << 24
        of_byte = np.repeat(np.arange(docs), np.diff(w.offsets))
        inside = of_byte[:-3] == of_byte[3:]
        quad, of_quad = code[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), of_byte[:-3][inside]
        quad = quad >> np.uint64(32)
    low = np.uint64(buckets - 1)
    return np.concatenate([of_word, of_word[1:][same], of_quad]), (np.concatenate([w.hash, pair, quad]) & low).astype(np.int64)


def _counts(docs: DataFrame, buckets: int, sieve: Sieve) -> DataFrame:
    """(bucket, n, good) over all texts, good over those whose doc_id passes the sieve: every task adds up its own before anything is shuffled."""
    sent = sieve.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total, good = Tokenizer(), np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            inside = passing(sent.value, batch.column(1))
            for w in tokens.chunks(batch.column(0)):
                of, bucket = features(w, buckets)
                total += np.bincount(bucket, minlength=buckets)
                good += np.bincount(bucket[inside[w.lo : w.hi][of]], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at]), pa.array(good[at])], names=["bucket", "n", "good"])

    return docs.select("text", sieve.places().alias("places")).mapInArrow(run, "bucket long, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))


def _passing_rows(docs: DataFrame, sieve: Sieve) -> DataFrame:
    sent = sieve.sent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passing(sent.value, batch.column(batch.num_columns - 1)))).drop_columns(["places"])

    return docs.withColumn("places", sieve.places()).mapInArrow(run, docs.schema)


def likelihood_ratio(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> np.ndarray:
    """The log ratio of every bucket: a vector of fixed length, whatever the corpus. ``trusted`` has the doc_id of the trusted documents.

    Texts stay where they are: one pass counts all of them and those that pass a sieve of the trusted ids. The ids that pass wrongly come from a join of
    ids alone; only their texts are shuffled, counted, and taken off again.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    sieve = Sieve(ids, 11)
    table = _counts(docs, buckets, sieve).toPandas()
    n, g = np.zeros(buckets), np.zeros(buckets)
    n[table["bucket"].to_numpy(np.int64)], g[table["bucket"].to_numpy(np.int64)] = table["n"], table["good"]
    wrong = stage(_passing_rows(docs.select("doc_id"), sieve).join(ids, "doc_id", "left_anti").distinct())
    if not wrong.isEmpty():
        again = Sieve(wrong, 21)
        rows = _passing_rows(docs.select("doc_id", "text"), again).join(wrong, "doc_id", "left_semi")
        off = _counts(rows, buckets, again).toPandas()
        g[off["bucket"].to_numpy(np.int64)] -= off["n"]
    if not g.sum():
        return np.zeros(buckets)
    return np.log((g * (n.sum() / g.sum()) + prior) / (n + prior))


def base_counts(w: Words) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every document of a run."""
    docs = len(w.ptr) - 1
    running = lambda flags: np.concatenate([[0], np.cumsum(flags)])
    n_words = np.diff(w.ptr)
    of_word = np.repeat(np.arange(docs), n_words)
    letters = running((w.data & 0xC0) != 0x80)
    chars = np.bincount(of_word, (letters[w.end] - letters[w.start]), docs).astype(np.int64)
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    symbols = running(is_symbol[w.data])
    n_symbols = symbols[w.offsets[1:]] - symbols[w.offsets[:-1]]
    repeated = np.zeros(len(w.hash), bool)
    if len(w.hash) > 2:
        inside = of_word[2:] == of_word[:-2]
        window = mix(mix(w.hash[:-2] * np.uint64(3) + w.hash[1:-1]) * np.uint64(5) + w.hash[2:] + of_word[2:].astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        at = np.flatnonzero(inside)
        order = at[np.argsort(window[at])]
        ranked = window[order]
        equal = ranked[1:] == ranked[:-1]
        hit = np.zeros(len(w.hash), bool)
        hit[order[1:][equal]] = hit[order[:-1][equal]] = True
        repeated[:] = hit
        repeated[1:] |= hit[:-1]
        repeated[2:] |= hit[:-2]
    n_repeat = np.bincount(of_word, repeated, docs).astype(np.int64)
    dup = np.zeros(docs, np.int64)
    for i in range(docs):
        lines = [x for x in w.data[w.offsets[i] : w.offsets[i + 1]].tobytes().split(b"\n") if x.split(None, 1)]
        dup[i] = len(lines) - len(set(lines))
    return [n_words.astype(np.int64), chars, n_symbols.astype(np.int64), dup, n_repeat]


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept added.

    ``trusted`` holds the doc_id of trusted documents (repeated or null ids don't matter; without any, every log ratio is 0).
    kept: base_failed is false and llr >= ``threshold``. A null text counts as empty: it has no words and fails the base rules.
    Rows repeat as they do in ``docs``; columns of these names are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    added = [*names, "base_failed", "llr", "kept"]
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    weights = kept.sparkSession.sparkContext.broadcast(likelihood_ratio(docs, trusted, buckets, prior))
    schema = type(kept.schema)(list(kept.schema.fields))
    for name in names:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("llr", "double").add("kept", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokenizer()
        for batch in batches:
            for w in tokens.chunks(batch.column(batch.schema.get_field_index("text"))):
                docs = w.hi - w.lo
                counts = base_counts(w)
                of, bucket = features(w, buckets)
                llr = np.bincount(of, weights.value[bucket], docs) / np.maximum(np.bincount(of, minlength=docs), 1)
                failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
                rows = batch.slice(w.lo, docs)
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, counts), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= threshold))], names=[*rows.schema.names, *added])

    return kept.mapInArrow(run, schema)


def trusted_documents(labels: DataFrame) -> DataFrame:
    """The doc_id that a label table marks as of good quality."""
    return labels.where("quality = 1").select("doc_id")
