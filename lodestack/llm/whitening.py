"""Embedding whitening by the exact characteristic polynomial of the integer scatter matrix."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from decimal import Decimal, localcontext
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import freeing, written

#: An entry c becomes floor(GRID c).
GRID = 256

#: Entries are smaller than this, so that products of grid values are added up exactly in 38 digits.
LARGEST = 2.0**44

#: Roots are known to so many bits of the largest possible root; what lies closer counts as one multiple root, any basis of whose space is a right one.
ROOT_BITS = 240

#: Primes that a task works with at once.
PRIMES_PER_TASK = 32

_INT64 = np.iinfo(np.int64)


# Vectors on the grid. They travel as the narrowest of 1, 2, 4 or 8 bytes an entry, so equal vectors are equal bytes.


def _grid(batch: pa.RecordBatch, column: str, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows of the batch whose vector is whole, finite, not over LARGEST and of ``dimension`` entries, and those vectors on the grid."""
    vectors = batch.column(column)
    vectors = vectors.cast(pa.list_(pa.float64())) if not pa.types.is_float64(vectors.type.value_type) else vectors
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    bad = ~(np.abs(np.asarray(vectors.flatten().fill_null(math.nan))) < LARGEST)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    good = (sizes > 0) & (np.bincount(owner, weights=bad, minlength=len(sizes)) == 0)
    if dimension is not None:
        good &= sizes == dimension
        rows = np.flatnonzero(good)
        values = np.asarray(vectors.filter(pa.array(good)).flatten())
        return rows, np.floor(values * GRID).astype(np.int64).reshape(len(rows), dimension)
    return np.flatnonzero(good), sizes


def _packed(x: np.ndarray) -> list[bytes]:
    most = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1)) if len(x) else np.zeros(0, np.int64)
    width = np.searchsorted([1 << 7, 1 << 15, 1 << 31], most, "right")
    out: list = [b""] * len(x)
    for k, kind in enumerate(("<i1", "<i2", "<i4", "<i8")):
        for row in np.flatnonzero(width == k):
            out[row] = x[row].astype(kind).tobytes()
    return out


def _unpacked(packed: list[bytes], dimension: int) -> np.ndarray:
    out = np.empty((len(packed), dimension), np.int64)
    sizes = np.array([len(p) for p in packed], np.int64) // dimension
    for width in (1, 2, 4, 8):
        at = np.flatnonzero(sizes == width)
        if len(at):
            out[at] = np.frombuffer(b"".join([packed[k] for k in at]), f"<i{width}").reshape(len(at), dimension)
    return out


def _dimension(rows: DataFrame) -> int | None:
    """The length of most whole vectors; of equally frequent ones the largest."""

    def sizes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, size = _grid(batch, "vector")
            own, n = np.unique(size[good], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(n)], ["size", "n"])

    found = rows.select("vector").mapInArrow(sizes, "size long, n long").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return found and found["size"]


def fit_list(rows: DataFrame, dimension: int) -> DataFrame:
    """Each different vector on the grid once: x (packed). Tasks leave out what a batch repeats before the shuffle."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set(_packed(_grid(batch, "vector", dimension)[1]))), pa.binary())], ["x"])

    return rows.select("vector").mapInArrow(freeing(packed), "x binary").distinct()


def scatter(fit: DataFrame, dimension: int) -> tuple[int, list[int], np.ndarray]:
    """(n, S, M): the number of vectors, their sums, and the whole matrix n sum(x x') - S S' = n^2 V, as Python's integers."""
    pairs = list(combinations_with_replacement(range(dimension), 2))
    upper = np.triu_indices(dimension)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(dimension, object), np.zeros((dimension, dimension), object)
        for batch in batches:
            x = _unpacked(batch.column("x").to_pylist(), dimension)
            most = int(np.abs(x).max(initial=0)) + 1
            whole = x if len(x) * most * most < _INT64.max else x.astype(object)  # products in 64 bits, or in integers of any length
            if len(x) * most * most < 2**53:
                gram = (x.T.astype(float) @ x.astype(float)).astype(np.int64)  # whole numbers that doubles hold
            else:
                gram = whole.T @ whole
            n, sums, total = n + len(x), sums + whole.sum(axis=0), total + gram
        values = [n, *sums.tolist(), *total[upper].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(map(str, values))], ["at", "value"])

    found = fit.mapInArrow(freeing(products), "at int, value string").groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    value = [int(v) for _, v in sorted((r.at, r.value) for r in found.collect())] or [0] * (1 + dimension + len(pairs))
    n, sums = value[0], value[1 : 1 + dimension]
    matrix = np.zeros((dimension, dimension), object)
    for (i, j), v in zip(pairs, value[1 + dimension :]):
        matrix[i, j] = matrix[j, i] = n * v - sums[i] * sums[j]
    return n, sums, matrix


# The characteristic polynomial: by primes, each on its own, then by Chinese remainders.


def primes(count: int) -> list[int]:
    """The largest ``count`` primes below 2^31."""
    prime = np.ones(46342, bool)
    prime[:2] = False
    for k in range(2, 216):
        prime[k * k :: k] = False
    small, found = np.flatnonzero(prime), []
    top = 1 << 31
    while len(found) < count:
        low = top - (1 << 16)
        sieve = np.ones(top - low, bool)
        for p in small:
            sieve[(-low) % p :: p] = False
        found += (low + np.flatnonzero(sieve))[::-1].tolist()
        top = low
    return found[:count]


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """a^(p - 2) mod p, for each prime."""
    out, base, power = np.ones_like(a), a % p, p - 2
    while power.any():
        out = np.where(power & 1, out * base % p, out)
        base, power = base * base % p, power >> 1
    return out


def modular_polynomial(residues: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients of det(t - A) mod p, the constant first, for each prime and its matrix; Hessenberg form by similar matrices, then its recurrence."""
    a, count, d = residues.copy(), len(p), residues.shape[1]
    every, q = np.arange(count), p[:, None]
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(a[:, k + 1 :, k] != 0, axis=1)  # the first row below the diagonal that isn't 0, if any
        rows = a[every, pivot].copy()
        a[every, pivot] = a[:, k + 1]
        a[:, k + 1] = rows
        columns = a[every, :, pivot].copy()
        a[every, :, pivot] = a[:, :, k + 1]
        a[:, :, k + 1] = columns
        factor = a[:, k + 2 :, k] * _inverse(a[:, k + 1, k], p)[:, None] % q
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, k + 1][:, None, :]) % p[:, None, None]
        # one column at a time: the sum of products would not fit into 64 bits
        add = np.zeros((count, d), np.int64)
        for j in range(factor.shape[1]):
            add = (add + factor[:, j][:, None] * a[:, :, k + 2 + j]) % q
        a[:, :, k + 1] = (a[:, :, k + 1] + add) % q
    found = np.zeros((d + 1, count, d + 1), np.int64)  # of the leading k x k parts
    found[0, :, 0] = 1
    for k in range(1, d + 1):
        own = np.zeros((count, d + 1), np.int64)
        own[:, 1:] = found[k - 1][:, :-1]
        own = (own - a[:, k - 1, k - 1][:, None] * found[k - 1]) % q
        below = np.ones(count, np.int64)
        for i in range(k - 2, -1, -1):
            below = below * a[:, i + 1, i] % p
            own = (own - (below * a[:, i, k - 1] % p)[:, None] * found[i]) % q
        found[k] = own
    return found[d]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """The whole coefficients of det(t - M), the constant first. Primes are dealt to tasks; there are enough of them for the largest coefficient there can be."""
    d = len(matrix)
    norm = max(1, max(sum(abs(int(v)) for v in row) for row in matrix))  # no root is larger
    bits = max(math.comb(d, k).bit_length() + k * norm.bit_length() for k in range(d + 1)) + 2
    count = bits // 30 + 1
    entries = matrix.tolist()

    def remainders(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("prime").to_numpy()
            for start in range(0, len(every), PRIMES_PER_TASK):
                p = every[start : start + PRIMES_PER_TASK]
                residues = np.array([[[v % int(q) for v in row] for row in entries] for q in p], np.int64)
                found = modular_polynomial(residues, p)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "found"])

    own = spark.createDataFrame([(q,) for q in primes(count)], "prime long").repartition(max(1, -(-count // PRIMES_PER_TASK)))
    rows = own.mapInArrow(remainders, "prime long, found array<long>").collect()
    product = math.prod(r.prime for r in rows)
    out = [0] * (d + 1)
    for r in rows:
        rest = product // r.prime
        unit = rest * pow(rest, -1, r.prime)
        for k, v in enumerate(r.found):
            out[k] += v * unit
    return [v % product - product * (2 * (v % product) > product) for v in out]


# Its largest roots. All are real and not negative, so the sign changes of p(t + a) count the roots above a, multiple ones as often.


def _shifted(p: list[int], a: int) -> list[int]:
    out = list(p)
    for i in range(len(out) - 1):
        for j in range(len(out) - 2, i - 1, -1):
            out[j] += a * out[j + 1]
    return out


def _roots_above(p: list[int], a: int) -> int:
    signs = [v > 0 for v in _shifted(p, a) if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _stretched(p: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    d = len(p) - 1
    return [v << (bits * (d - k)) for k, v in enumerate(p)]


def largest_roots(p: list[int], count: int, bound: int) -> list[tuple[Decimal, int]]:
    """(root, multiplicity) of the ``count`` largest positive roots, the largest first; none is over ``bound``.

    Intervals are halved until each holds one root, or is of 2^-ROOT_BITS of the bound; a lone root's sign change goes on being halved to that width.
    """
    top, out = bound.bit_length(), []
    stack = [(0, 0, _roots_above(p, 0), 0)]  # the interval (k, k + 1] 2^top / 2^bits: (k, bits, roots above its low end, roots above its high end)

    def above(k: int, bits: int) -> int:
        shift = bits - top
        return _roots_above(_stretched(p, shift), k) if shift > 0 else _roots_above(p, k << -shift)

    while stack and sum(m for _, m in out) < count:
        k, bits, low, high = stack.pop()
        if low == high:
            continue
        if low - high == 1 or bits >= ROOT_BITS:
            out.append((_narrowed(p, k, bits, top) if low - high == 1 else _point(2 * k + 1, bits + 1, top), low - high))
            continue
        middle = above(2 * k + 1, bits + 1)
        stack += [(2 * k, bits + 1, low, middle), (2 * k + 1, bits + 1, middle, high)]
    return out


def _point(k: int, bits: int, top: int) -> Decimal:
    """k 2^top / 2^bits."""
    with localcontext() as context:
        context.prec = ROOT_BITS + top + 20
        return Decimal(k) * Decimal(2) ** top / Decimal(2) ** bits


def _narrowed(p: list[int], k: int, bits: int, top: int) -> Decimal:
    """The one root in (k, k + 1] 2^top / 2^bits, by the polynomial's sign at the middle."""

    def sign(k: int, bits: int) -> int:
        shift, value = bits - top, 0
        point = k if shift > 0 else k << -shift
        for power, v in enumerate(reversed(p)):
            value = value * point + (v << (shift * power) if shift > 0 else v)
        return (value > 0) - (value < 0)

    high = sign(k + 1, bits)
    if not high:
        return _point(k + 1, bits, top)
    while bits < ROOT_BITS:
        k, bits = 2 * k, bits + 1
        if sign(k + 1, bits) != high:
            k += 1
    return _point(2 * k + 1, bits + 1, top)


# Components: inverse iteration on the null space of M - root, in decimals of as many digits as the roots have.


def null_space(matrix: np.ndarray, root: Decimal, count: int) -> np.ndarray:
    """``count`` orthonormal vectors (rows, as doubles) of the space that ``matrix`` nearly maps to root times itself."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = digits = int(ROOT_BITS * 0.302) * 2 + 40
        tiny = max(root, Decimal(1)) * Decimal(10) ** (-digits + 20)
        a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        a[np.diag_indices(d)] -= root
        order = np.arange(d)
        for k in range(d):
            pivot = k + int(np.argmax([abs(v) for v in a[k:, k]]))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            factor = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k] = factor
            a[k + 1 :, k + 1 :] -= factor[:, None] * a[k, k + 1 :]
        vectors = [np.array([Decimal((i * i * 7 + 3 * i * v + 11 * v + 5) % 101 + 1) for i in range(d)], object) for v in range(count)]
        for _ in range(3):
            solved: list[np.ndarray] = []
            for b in vectors:
                y = b[order].copy()
                for k in range(d):
                    y[k + 1 :] -= a[k + 1 :, k] * y[k]
                for k in range(d - 1, -1, -1):
                    y[k] = (y[k] - (a[k, k + 1 :] * y[k + 1 :]).sum()) / a[k, k]
                y = y / max(abs(v) for v in y)
                for _ in range(2):
                    for other in solved:
                        y = y - (y * other).sum() * other
                solved.append(y / (y * y).sum().sqrt())
            vectors = solved
        return np.array([[float(v) for v in y] for y in vectors])


class Whitening:
    """What whitens: n and S of the fit list, its components (rows), their eigenvalues, and the share of the variance that each explains."""

    def __init__(self, n: int, sums: list[int], components: np.ndarray, values: np.ndarray, explained: np.ndarray) -> None:
        self.n, self.sums, self.components, self.values, self.explained = n, sums, components, values, explained

    def project(self, x: np.ndarray) -> np.ndarray:
        """The whitened coordinates of vectors on the grid. The centre is taken off before products, its fraction apart, so nothing large cancels."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([(s % self.n) / self.n for s in self.sums])
        return ((x - whole) - part) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """sum((n x - S)^2) of each vector, exactly."""
        most = max(self.n * (int(np.abs(x).max(initial=0)) + 1), 1) + max(map(abs, self.sums))
        if x.shape[1] * most * most <= _INT64.max:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1).tolist()


def fit_whitening(fit: DataFrame, dimension: int, components: int) -> Whitening | None:
    """Learn from the fit list. Components of no variance (fewer different vectors than dimensions, say) don't exist; without any: None."""
    n, sums, matrix = scatter(fit, dimension)
    trace = sum(int(matrix[k, k]) for k in range(dimension))
    if not n or not trace:
        return None
    polynomial = characteristic_polynomial(fit.sparkSession, matrix)
    roots = largest_roots(polynomial, min(components, dimension), trace)
    vectors = [v for root, times in roots for v in null_space(matrix, root, times)][:components]
    each = [root for root, times in roots for _ in range(times)][:components]
    with localcontext() as context:
        context.prec = 60
        values = np.array([float(r / (Decimal(n) * n)) for r in each])
        explained = np.array([float(r / Decimal(trace)) for r in each])
    return Whitening(n, sums, np.array(vectors), values, explained)


def _identity_error(fit: DataFrame, whitening: Whitening, dimension: int) -> float:
    """The largest absolute entry of the covariance of the fit list's whitened coordinates minus the identity."""
    count = len(whitening.values)

    def projected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = whitening.project(_unpacked(batch.column("x").to_pylist(), dimension))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in range(count)], [f"w{k}" for k in range(count)])

    rows = fit.mapInArrow(freeing(projected), ", ".join(f"w{k} double" for k in range(count)))
    pairs = list(combinations_with_replacement(range(count), 2))
    found = rows.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))


def whiten(df: DataFrame, *, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per whole vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Entries c become x = floor(256 c). Each different x counts once: n of them, sums S, covariance V. Components are V's unit eigenvectors by falling
    eigenvalue e, numbered from 1; ``whitened`` is (x - S / n) projected on one, over sqrt(e); ``explained`` is e / trace(V); ``deviation`` is the whole number
    sum((n x - S)^2), null beyond 64 bits; ``identity_error`` is the largest entry of the whitened fit list's covariance minus the identity.

    The eigenvalues are roots of the characteristic polynomial of n^2 V, a matrix of whole numbers: its coefficients are found modulo primes, by tasks, and put
    together by Chinese remainders. Intervals that hold one root each follow from its sign changes; inverse iteration in long decimals gives the components. So
    no close eigenvalues or large means cost digits. Equal eigenvalues share a space: any orthonormal basis of it may come out.

    Rows with a null vector, null or non-finite entries (or entries of LARGEST or more), or of another length than most (of equally frequent lengths the longest counts) are left out. Null ids
    and repeated rows are kept. Components of eigenvalue 0 don't exist: equal vectors, or an empty table, give no rows. Other columns are not read.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    dimension = _dimension(rows)
    fit = dimension and written(fit_list(rows, dimension))
    whitening = fit and fit_whitening(fit, dimension, components)
    if not whitening:
        return df.sparkSession.createDataFrame([], schema)
    error = _identity_error(fit, whitening, dimension)
    count = len(whitening.values)

    def whitened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _grid(batch, "vector", dimension)
            far = [v if v <= _INT64.max else None for v in whitening.deviation(x)]
            columns = [
                batch.column("vec_id").take(pa.array(np.repeat(at, count))), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * count, whitening.n)),
                pa.array(far, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), count))), pa.array(whitening.project(x).ravel()), pa.array(np.tile(whitening.explained, len(at))),
                pa.array(np.full(len(at) * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(freeing(whitened), schema)
