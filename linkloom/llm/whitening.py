"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix.

Entries become integers x = floor(scale * c). The fit list is each distinct x once: n vectors with sums S. The scatter M = n * sum(x x') - S S' is
n**2 times their covariance, and exact: tasks add up integer products, which Spark sums limb by limb. Its characteristic polynomial comes from
Hessenberg reductions modulo 31-bit primes, one row of a Spark job each, joined by Chinese remaindering; a prime that was left out must agree. All roots
are real, so the sign changes of the polynomial shifted by a, in exact integers, count the roots above a (Descartes); bisection by that count
isolates the k-th largest root. Components are null vectors of M - root by inverse iteration with 120 digits.

What reaches the driver is bounded by the dimension alone: (d + 1)**2 sums and d + 1 remainders for each prime.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

SCALE = 256
MOST = 4  # components that are returned
LIMB = 31  # bits of a part of a sum
BITS = 200  # of a root, from its first
DIGITS = 120


def integer_vectors(df: DataFrame, column: str, scale: int = SCALE) -> DataFrame:
    """Rows of ``df`` with x, without those whose vector is null or holds null, NaN or an infinity, and those that are not of the commonest length."""
    bad = F.exists(column, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    sound = df.where(F.col(column).isNotNull() & ~bad)
    size = sound.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if size is None:
        return sound.where(F.lit(False)).withColumn("x", F.array().cast("array<long>"))
    return sound.where(F.size(column) == size["d"]).withColumn("x", F.transform(column, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _most(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def _products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers: in doubles or 64 bits where no sum can leave them."""
    bound = _most(x) ** 2 * len(x)
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    y = x.astype(kind)
    return (y.T @ y).astype(np.int64 if kind is np.float64 else kind).astype(object)


def scatter(fit: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and the scatter M of the vectors x of ``fit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d + 1, d + 1), object)
        for batch in batches:
            x = _matrix(batch.column(0), d)
            total += _products(np.hstack([x, np.ones((len(x), 1), np.int64)]))
        rows = []
        for i, j in zip(*np.triu_indices(d + 1), strict=True):
            value, sign, k = abs(int(total[i, j])), -1 if total[i, j] < 0 else 1, 0
            while value:
                rows.append((int(i), int(j), k, sign * (value & ((1 << LIMB) - 1))))
                value, k = value >> LIMB, k + 1
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=["i", "j", "k", "v"])

    sums = fit.select("x").mapInArrow(run, "i long, j long, k long, v long").groupBy("i", "j", "k").agg(F.sum("v").alias("v")).collect()
    g = [[0] * (d + 1) for _ in range(d + 1)]
    for r in sums:
        g[r["i"]][r["j"]] += r["v"] << (LIMB * r["k"])
    n, s = g[d][d], [g[i][d] for i in range(d)]
    return n, s, [[n * g[min(i, j)][max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]


def _is_prime(n: int) -> bool:
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):  # enough below 3.2e9
        x = pow(a, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes(count: int) -> list[int]:
    """The largest primes below 2**31."""
    out, p = [], (1 << 31) - 1
    while len(out) < count:
        if _is_prime(p):
            out.append(p)
        p -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """The characteristic polynomial modulo ``p``, lowest coefficient first: similar Hessenberg form, then the recurrence over its leading blocks."""
    a, d = m % p, len(m)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        r = k + 1 + below[0]
        if r != k + 1:
            a[[k + 1, r]] = a[[r, k + 1]]
            a[:, [k + 1, r]] = a[:, [r, k + 1]]
        u = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - u[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * u % p).sum(axis=1)) % p
    blocks = [np.zeros(d + 1, np.int64)]
    blocks[0][0] = 1
    for k in range(d):
        q = (np.roll(blocks[k], 1) - a[k, k] * blocks[k] % p) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            if not chain:
                break
            q = (q - chain * int(a[i, k]) % p * blocks[i] % p) % p
        blocks.append(q)
    return blocks[d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """The polynomial det(x - m) of a positive semidefinite integer matrix in exact integers, lowest coefficient first."""
    d = len(m)
    bound = (sum(m[i][i] for i in range(d)) // d + 2) ** d  # above every coefficient, by the means of the eigenvalues
    chosen = primes((2 * bound).bit_length() // 30 + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                values = polynomial_mod(np.array([[v % p for v in row] for row in m], np.int64), p)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([values.tolist()])], names=["p", "c"])

    slices = min(len(chosen), max(spark.sparkContext.defaultParallelism, 8))
    found = spark.range(len(chosen), numPartitions=slices).select(F.get(F.lit(chosen), F.col("id").cast("int")).cast("long").alias("p"))
    parts = sorted(((r["p"], r["c"]) for r in found.mapInArrow(run, "p long, c array<long>").collect()), reverse=True)
    value, modulus = [0] * (d + 1), 1
    for p, c in parts[:-1]:
        inverse = pow(modulus, -1, p)
        value = [v + modulus * ((x - v) * inverse % p) for v, x in zip(value, c, strict=True)]
        modulus *= p
    value = [v - modulus if v > modulus // 2 else v for v in value]
    if [v % parts[-1][0] for v in value] != list(parts[-1][1]):
        raise ArithmeticError("the characteristic polynomial does not hold for the prime that was left out")
    return value


def roots_above(poly: list[int], at: int, places: int = 0) -> int:
    """How many roots of a polynomial whose roots are all real lie above at / 2**places, repeated ones counted."""
    d = len(poly) - 1
    c = [v << (places * (d - i)) for i, v in enumerate(poly)]
    if at:
        for i in range(d):
            for j in range(d - 1, i - 1, -1):
                c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def kth_root(poly: list[int], k: int, top: int, bits: int = BITS) -> tuple[int, int]:
    """(m, places): the k-th largest root, positive and at most ``top``, lies in ((m - 1) / 2**places, m / 2**places]; m has ``bits`` bits."""
    low, high, places = 0, top, 0
    while high - low > 1 or high.bit_length() < bits:
        if high - low == 1:
            low, high, places = 2 * low, 2 * high, places + 1
        middle = (low + high) // 2
        if roots_above(poly, middle, places) >= k:
            low = middle
        else:
            high = middle
    return high, places


def _solver(m: list[list[int]], root: Decimal):
    """Solves (m - root) y = b by elimination with row exchanges; a vanishing pivot counts as a tiny one."""
    d = len(m)
    a = np.array([[Decimal(v) for v in row] for row in m], object)
    for i in range(d):
        a[i, i] -= root
    tiny = (abs(root) + 1) * Decimal(10) ** -(DIGITS - 10)
    order = []
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        order.append(r)
        a[[k, r]] = a[[r, k]]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        if k + 1 < d:
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for k, r in enumerate(order):  # exchanges in full first: the factors were exchanged along
            y[[k, r]] = y[[r, k]]
        for k in range(d):
            y[k + 1 :] -= a[k + 1 :, k] * y[k]
        for k in range(d - 1, -1, -1):
            y[k] = y[k] / a[k, k]
            y[:k] -= a[:k, k] * y[k]
        return y

    return solve


def _unit(y: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in others:
            y = y - v * sum(y * v)
        y = y / sum(y * y).sqrt()
    return y


def components(m: list[list[int]], poly: list[int], most: int = MOST) -> list[tuple[Decimal, list[Decimal]]]:
    """The largest positive eigenvalues and their unit vectors, largest entry positive, with far more digits than a double has. Equal eigenvalues
    (to ``BITS`` bits) share an eigenspace, of which orthogonal vectors are taken. Fewer than ``most`` if fewer are positive."""
    d, out = len(m), []
    top = sum(m[i][i] for i in range(d)) + 1
    with localcontext() as context:
        context.prec = DIGITS
        for k in range(1, min(most, d, roots_above(poly, 0)) + 1):
            high, places = kth_root(poly, k, top)
            root = Decimal(2 * high - 1) / Decimal(1 << (places + 1))
            solve, before = _solver(m, root), [np.array(v, object) for _, v in out]
            y = _unit(np.array([Decimal((i * i * 7919 + k * 104729 + i) % 1009 - 504) for i in range(d)], object), before)
            for _ in range(3):
                y = _unit(solve(y), before)
            if y[int(np.argmax([abs(v) for v in y]))] < 0:
                y = -y
            gap = max(abs(sum(Decimal(v) * x for v, x in zip(row, y, strict=True)) - root * t) for row, t in zip(m, y, strict=True))
            if gap > root * Decimal(10) ** -30:
                raise ArithmeticError("inverse iteration has not settled")
            out.append((root, y.tolist()))
    return out


def whiten(df: DataFrame, key: str, column: str, scale: int = SCALE, most: int = MOST) -> DataFrame:
    """For each sound row and component: ``key``, component, n, deviation, whitened, explained, identity_error (see :func:`integer_vectors` for the rows
    that are left out).

    Repeated rows and ids give a row each; equal vectors count once in the fit. Null ids stay null. Other columns, whatever their names, are not read. Components
    without variance don't count: a table that is empty, has one distinct vector or vectors of no entries gives no rows. ``deviation`` is null where it
    leaves 64 bits. Entries beyond 64 bits are taken as the nearest long."""
    spark = df.sparkSession
    vectors = integer_vectors(df.select(F.col(f"`{key}`").alias("_id"), F.col(f"`{column}`").alias("_vector")), "_vector", scale).select(F.col("_id").alias("_key"), "x")
    kind = f"_key {df.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = stage(vectors.select("x").distinct())
    one = fit.first()
    d = len(one["x"]) if one else 0
    found = []
    if d:
        n, s, m = scatter(fit, d)
        found = components(m, characteristic_polynomial(spark, m), most) if any(any(row) for row in m) else []
    if not found:
        return spark.createDataFrame([], kind).withColumnRenamed("_key", key)
    total = sum(m[i][i] for i in range(d))
    with localcontext() as context:
        context.prec = DIGITS
        weights = np.array([[float(v / root.sqrt()) for v in vector] for root, vector in found])
        explained = [float(root / total) for root, _ in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), d)
            wide = (n * _most(x) + max(map(abs, s))) ** 2 * d >= 1 << 63
            y = (x.astype(object) if wide else x) * n - np.array(s, object if wide else np.int64)
            deviation = [v if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]
            projected = y.astype(np.float64) @ weights.T
            arrays = [pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(weights), pa.array(projected.ravel()))]
            keys = [batch.column("_key")] if "_key" in batch.schema.names else []
            yield pa.RecordBatch.from_arrays([*keys, *arrays], names=["_key", "deviation", "w"][1 - len(keys) :])

    fitted = fit.select("x").mapInArrow(run, "deviation long, w array<double>")
    w = [F.col("w")[i] for i in range(len(found))]
    means = fitted.agg(*[F.avg(x) for x in w]).first()
    pairs = [(a, b) for a in range(len(found)) for b in range(a + 1)]
    covariance = fitted.agg(*[F.avg((w[a] - F.lit(means[a])) * (w[b] - F.lit(means[b]))) for a, b in pairs]).first()
    error = max(abs(v - (a == b)) for (a, b), v in zip(pairs, covariance, strict=True))
    rows = vectors.mapInArrow(run, f"_key {df.schema[key].dataType.simpleString()}, deviation long, w array<double>")
    return rows.select("_key", "deviation", F.posexplode("w").alias("_at", "whitened")).select(
        F.col("_key").alias(key),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(F.lit(explained), F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
