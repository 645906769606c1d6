"""Words of whole Arrow batches as 64-bit hashes, without a Python object per word.

A word's hash is the polynomial sum of its bytes' codes, taken from one running sum over the batch and made independent of
the word's place by the inverse power of the base, then mixed. Equal words have equal hashes everywhere; the reverse holds
but for 64-bit collisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: out[done:2*done] = out[:done] * base**done
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


@dataclass
class Words:
    """The words of documents lo..hi of a batch. ptr: word range of each document; start, end: byte range of each word in data."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray
    hash: np.ndarray


class Tokenizer:
    """Cuts string arrays into words; ``fold`` lower-cases A-Z before hashing."""

    def __init__(self, fold: bool = False):
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        codes = np.arange(256, dtype=np.uint64)
        if fold:
            codes[65:91] += 32
        self.code = mix(codes + np.uint64(0x51ED27))
        self.power = self.inverse = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            self.power, self.inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def chunks(self, texts: pa.Array, chunk: int = CHUNK) -> Iterator[Words]:
        """``texts`` (nulls as empty) in runs of about ``chunk`` bytes; a longer text is a run of its own."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        if not len(texts):
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, "right")) - 1)
            yield self._run(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi

    def _run(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray) -> Words:
        n = len(data)
        if not n:
            none = np.empty(0, np.int64)
            return Words(lo, hi, data, offsets, none, none, np.zeros(hi - lo + 1, np.int64), np.empty(0, np.uint64))
        self._grow(n + 1)
        space = self.space[data]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:] = space[:-1]
        after[:-1] = space[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        before[inner] = True
        after[inner - 1] = True
        start = np.flatnonzero(~space & before)
        end = np.flatnonzero(~space & after) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.code[data] * self.power[:n], out=total[1:])
        value = (total[end] - total[start]) * self.inverse[start]
        return Words(lo, hi, data, offsets, start, end, np.searchsorted(start, offsets), mix(value + (end - start).astype(np.uint64)))


_K = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of fewer words, the whole sequence as one; of none, none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size_here = min(size, n)
    total = np.full(n - size_here + 1, size_here, np.uint64)
    for i in range(size_here):
        total = mix(total * _K[i % 8] + words[i : n - size_here + 1 + i])
    return total
