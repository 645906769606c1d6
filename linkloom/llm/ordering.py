"""An order of n-grams, rare ones first, that all tasks share.

Candidate search takes the first few n-grams of each row in this order as keys. Any order gives the same links; this one keeps the keys' groups small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: N-grams that are known as common, at most; the others are taken as equally rare.
MOST = 1 << 18
FLUSH = 1 << 22


class RareFirst:
    """The common n-grams' hashes, ascending, and how common each is (1 to 62)."""

    def __init__(self, value: np.ndarray, level: np.ndarray):
        self.value, self.level = value, level

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """0 for n-grams that aren't common."""
        if not len(self.value) or not len(grams):
            return np.zeros(len(grams), np.uint64)
        at = np.minimum(np.searchsorted(self.value, grams), len(self.value) - 1)
        return np.where(self.value[at] == grams, self.level[at], 0).astype(np.uint64)

    def rank(self, grams: np.ndarray) -> np.ndarray:
        """Numbers to sort n-grams by: level, then hash."""
        return self.levels(grams) << np.uint64(58) | grams >> np.uint64(6)


def _merged(value: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal values added up; of many values, the ``most`` most frequent."""
    value, at = np.unique(value, return_inverse=True)
    count = np.bincount(at, count, len(value)).astype(np.int64)
    if len(value) > most:
        keep = np.sort(np.argpartition(-count, most)[:most])
        value, count = value[keep], count[keep]
    return value, count


class GramCounts:
    """The ``most`` most frequent n-grams of a task, about, and how often each comes."""

    def __init__(self, most: int = MOST):
        self.most, self.value, self.count, self.waiting, self.n = most, np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append(grams)
        self.n += len(grams)
        if self.n > FLUSH:
            self._flush()

    def _flush(self) -> None:
        v, c = np.unique(np.concatenate(self.waiting), return_counts=True)
        self.value, self.count = _merged(np.concatenate([self.value, v[c > 1]]), np.concatenate([self.count, c[c > 1]]), self.most)
        self.waiting, self.n = [], 0

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            self._flush()
        return self.value, self.count


def rare_first(docs: DataFrame, grams: Callable[[pa.Array], Iterator[np.ndarray]]) -> RareFirst:
    """The order by the counts of ``grams`` over all texts of ``docs``. Tasks add up their own counts and send their most frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = GramCounts()
        for batch in batches:
            for found in grams(batch.column(0)):
                counts.add(found)
        value, count = counts.done()
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["gram", "n"])

    return order_of(docs.select("text").mapInArrow(run, "gram long, n long"))


def order_of(counts: DataFrame) -> RareFirst:
    """The order by the sums of ``counts`` (gram, n)."""
    sums = counts.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").persist()
    try:
        sizes = {r["k"]: r["c"] for r in sums.groupBy(F.floor(F.log2("n") * 2).alias("k")).agg(F.count("*").alias("c")).collect()}
        least, total = max(sizes, default=0) + 1, 0
        while least - 1 in sizes and total + sizes[least - 1] <= MOST or least > 0 and least - 1 not in sizes:
            least -= 1
            total += sizes.get(least, 0)
        top = sums.where(F.floor(F.log2("n") * 2) >= least).toArrow()
    finally:
        sums.unpersist()
    value = top.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(value)
    level = np.clip(2 * np.log2(np.maximum(top.column("n").to_numpy().astype(float), 1)), 1, 62).astype(np.uint8)
    return RareFirst(value[order], level[order])
