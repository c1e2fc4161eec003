"""Embedding whitening from the exact characteristic polynomial of an integer scatter matrix.

Entries become integers, so the scatter of the distinct vectors is exact however the rows are dealt. Its characteristic
polynomial is worked out modulo primes, a few a task, from Hessenberg forms and put together by Chinese remainders; their
number follows from a bound of the coefficients. All roots are real, so by Descartes' rule the sign changes of the
polynomial shifted to t count the roots beyond t exactly: the largest roots are parted by halving intervals, equal ones
told from close ones by the greatest common divisor with the derivative. Each root is then halved down to many digits
and its null space found by inverse iteration at as many, one root a task. Rows are projected where they lie.

What the driver holds is of the dimension alone: a matrix, its polynomial, the components.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal, localcontext
from math import comb, gcd, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch

#: What an entry is multiplied by and what is added to it.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
LIMB = 60
LARGEST = float(1 << 52)
ROOT_BITS = 160


# Arithmetic modulo a prime below 2 ** 31, so that products fit 63 bits.


def is_prime(n: int) -> bool:
    """Miller and Rabin's test with bases that decide below 3.2e9."""
    if n < 2 or n % 2 == 0:
        return n == 2
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if base % n and x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_below(top: int, count: int) -> list[int]:
    out = []
    while len(out) < count:
        top -= 1
        if is_prime(top):
            out.append(top)
    return out


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, the constant first, of det(xI - matrix) modulo p, by Hessenberg reduction."""
    a = matrix.copy()
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        at = k + 1 + below[0]
        if at != k + 1:
            a[[k + 1, at]] = a[[at, k + 1]]
            a[:, [k + 1, at]] = a[:, [at, k + 1]]
        by = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - by[:, None] * a[k + 1]) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * by % p).sum(axis=1)) % p
    polys = [np.zeros(d + 1, np.int64)]
    polys[0][0] = 1
    for k in range(d):
        last = polys[-1]
        new = np.roll(last, 1)
        new = (new - int(a[k, k]) * last) % p
        steps = 1
        for i in range(k - 1, -1, -1):
            steps = steps * int(a[i + 1, i]) % p
            if not steps:
                break
            new = (new - int(a[i, k]) * steps % p * polys[i]) % p
        polys.append(new)
    return polys[-1]


def gcd_with_derivative_mod(poly: np.ndarray, p: int) -> np.ndarray:
    """The monic greatest common divisor of a polynomial and its derivative modulo p, the constant first."""
    a = poly % p
    b = a[1:] * np.arange(1, len(a)) % p
    while len(b) and b.any():
        b = b[: np.flatnonzero(b)[-1] + 1]
        b = b * pow(int(b[-1]), -1, p) % p
        a = a.copy()
        for k in range(len(a) - len(b), -1, -1):
            a[k : k + len(b)] = (a[k : k + len(b)] - a[k + len(b) - 1] * b) % p
        a, b = b, a[: len(b) - 1]
    return a


def remainders(residues: dict[int, list[int]]) -> list[int]:
    """Integers of least size that have the given residues modulo each prime."""
    values, modulus = None, 1
    for p, rest in residues.items():
        if values is None:
            values, modulus = list(rest), p
            continue
        inverse = pow(modulus % p, -1, p)
        values = [v + modulus * ((r - v) * inverse % p) for v, r in zip(values, rest, strict=True)]
        modulus *= p
    return [v - modulus if 2 * v > modulus else v for v in values or []]


# Real roots.


def _scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2 ** bits times as large."""
    d = len(poly) - 1
    return [c << (bits * (d - k)) for k, c in enumerate(poly)]


def roots_beyond(poly: list[int], at: int) -> int:
    """How many roots, counted as often as they repeat, are larger than ``at``; all roots must be real."""
    c = list(poly)
    for k in range(len(c) - 1):
        for j in range(len(c) - 2, k - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], at: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * at + c
    return (value > 0) - (value < 0)


def divided(poly: list[int], by: list[int]) -> list[int]:
    """An exact quotient of integer polynomials, ``by`` monic."""
    rest, out = list(poly), []
    for k in range(len(poly) - len(by), -1, -1):
        out.append(rest[k + len(by) - 1])
        for j, c in enumerate(by):
            rest[k + j] -= out[-1] * c
    return out[::-1]


@dataclass(frozen=True)
class Root:
    """A root in (low, high] / 2 ** bits, and how often it repeats."""

    low: int
    high: int
    bits: int
    times: int


def largest_roots(poly: list[int], common: list[int], count: int) -> list[Root]:
    """Intervals of the largest positive roots, falling, each of one root, until ``count`` are had, repeats counted.

    ``common`` is the greatest common divisor with the derivative: it has each root once less, so the difference of the two
    counts is the number of different roots.
    """
    scaled: dict[int, tuple[list[int], list[int]]] = {}
    known: dict[tuple[int, int], tuple[int, int]] = {}

    def beyond(at: int, bits: int) -> tuple[int, int]:
        while bits and at % 2 == 0:
            at, bits = at // 2, bits - 1
        if (at, bits) not in known:
            if bits not in scaled:
                scaled[bits] = (_scaled(poly, bits), _scaled(common, bits))
            both, again = scaled[bits]
            n = roots_beyond(both, at)
            known[at, bits] = (n, n - (roots_beyond(again, at) if len(again) > 1 else 0))
        return known[at, bits]

    high = 1
    while beyond(high, 0)[0]:
        high *= 2
    out: list[Root] = []
    waiting = [(0, high, 0)]
    while waiting and sum(r.times for r in out) < count:
        low, high, bits = waiting.pop()
        (all_low, some_low), (all_high, some_high) = beyond(low, bits), beyond(high, bits)
        if some_low == some_high:
            continue
        if some_low - some_high == 1:
            out.append(Root(low, high, bits, all_low - all_high))
            continue
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        waiting += [(low, middle, bits), (middle, high, bits)]  # the upper half is looked at first
    return out


def refined(simple: list[int], root: Root, bits: int) -> Root:
    """The root's interval halved until it is narrower than 2 ** -bits of the root; ``simple`` has no repeated roots."""
    low, high, at = root.low, root.high, root.bits
    poly = _scaled(simple, at)
    above = _sign(poly, high)
    while above and (high - low) << bits > high:
        if high - low < 4:
            step = 64
            low, high, at = low << step, high << step, at + step
            poly = _scaled(simple, at)
        middle = (low + high) // 2
        sign = _sign(poly, middle)
        if not sign:
            low = high = middle
            break
        low, high = (low, middle) if sign == above else (middle, high)
    return Root(high if not above else low, high, at, root.times)


# Null spaces.


def null_space(matrix: list[list[int]], value: Decimal, times: int, digits: int) -> list[list[float]]:
    """Orthonormal vectors that span the matrix's null space at the eigenvalue ``value``, known to about ``digits`` digits.

    Inverse iteration from fixed vectors on a factorisation with that many digits, beside the eigenvalue by less than its own
    error; the entry of largest size is made positive.
    """
    with localcontext() as context:
        context.prec = digits + 20
        d = len(matrix)
        beside = value * (1 + Decimal(10) ** -digits)
        a = np.array([[Decimal(v) for v in row] for row in matrix], object)
        for k in range(d):
            a[k, k] -= beside
        order = np.arange(d)
        tiny = (abs(value) + 1) * Decimal(10) ** (-digits - 10)
        for k in range(d):
            at = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            if at != k:
                a[[k, at]] = a[[at, k]]
                order[[k, at]] = order[[at, k]]
            if not a[k, k]:
                a[k, k] = tiny
            if k + 1 < d:
                by = a[k + 1 :, k] / a[k, k]
                a[k + 1 :, k] = by
                a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - by[:, None] * a[k, k + 1 :]
        vectors = [np.array([Decimal(1 + (7919 * (i + 1) * (m + 1) ** 2) % 101) for i in range(d)], object) for m in range(times)]
        for _ in range(3):
            spanned: list[np.ndarray] = []
            for v in vectors:
                y = v[order]
                for k in range(1, d):
                    y[k] -= (a[k, :k] * y[:k]).sum()
                for k in range(d - 1, -1, -1):
                    y[k] = (y[k] - (a[k, k + 1 :] * y[k + 1 :]).sum()) / a[k, k] if k + 1 < d else y[k] / a[k, k]
                for _ in range(2):
                    y = y / (y * y).sum().sqrt()
                    for u in spanned:
                        y = y - (y * u).sum() * u
                spanned.append(y / (y * y).sum().sqrt())
            vectors = spanned
        out = []
        for v in vectors:
            largest = max(range(d), key=lambda i: abs(v[i]))
            out.append([float(x if v[largest] > 0 else -x) for x in v])
        return out


# On Spark.


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with ``sums`` per dimension; unit ``components`` by falling ``values``, the eigenvalues of their covariance.

    ``explained`` is each value's share of the trace, ``identity_error`` the largest absolute entry of the whitened fit list's
    covariance minus the identity.
    """

    n: int
    sums: list[int]
    components: list[list[float]] = field(default_factory=list)
    values: list[float] = field(default_factory=list)
    explained: list[float] = field(default_factory=list)
    identity_error: float = 0.0

    @property
    def dims(self) -> int:
        return len(self.sums)


def integers(vector: Column) -> Column:
    """``floor(64 c) + 1000000`` of each entry; null for a vector that is null or has null or non-finite entries.

    Entries beyond 2 ** 52 / 64 in size count as that.
    """
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    within = lambda c: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), c.cast("double") * SCALE))
    return F.when(~bad, F.transform(vector, lambda c: F.floor(within(c)) + F.lit(OFFSET).cast("long")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _limbs(value: int) -> tuple[int, int, int]:
    """Three numbers of 60 bits that have the value's sign and make it up."""
    sign, size, mask = (-1 if value < 0 else 1), abs(value), (1 << LIMB) - 1
    return sign * (size & mask), sign * (size >> LIMB & mask), sign * (size >> 2 * LIMB)


def gram(y: np.ndarray) -> np.ndarray:
    """y^T y in exact integers: by floating point where no sum can pass 2 ** 53, else by Python's integers."""
    size = int(np.abs(y).max(initial=0))
    if size * size * max(len(y), 1) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    o = y.astype(object)
    return o.T @ o


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and sums of products of the vectors' distances from ``OFFSET``, exact."""

    def run(batches):
        n, total, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            y = _matrix(batch.column(0), dims) - OFFSET
            n += len(y)
            total = total + y.astype(object).sum(axis=0)
            products = products + gram(y)
        if not n:
            return
        entries = [(-1, -1, n), *[(i, -1, int(total[i])) for i in range(dims)], *[(i, j, int(products[i, j])) for i in range(dims) for j in range(i, dims)]]
        cut = [(i, j, *_limbs(v)) for i, j, v in entries]
        cols = [pa.array([c[k] for c in cut], pa.int32() if k < 2 else pa.int64()) for k in range(5)]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "j", "a", "b", "c"])

    parts = fit.select("x").mapInArrow(run, "i int, j int, a long, b long, c long")
    rows = parts.groupBy("i", "j").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "abc"]).collect()  # a row per two dimensions
    found = {(r.i, r.j): int(r.a) + (int(r.b) << LIMB) + (int(r.c) << 2 * LIMB) for r in rows}
    if not found:
        return 0, [0] * dims, []
    total = [found[i, -1] for i in range(dims)]
    return found[-1, -1], total, [[found[min(i, j), max(i, j)] for j in range(dims)] for i in range(dims)]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> tuple[list[int], list[int]]:
    """The characteristic polynomial of a symmetric integer matrix without negative eigenvalues, and its greatest common
    divisor with its derivative, both exact, the constant first."""
    d, trace = len(matrix), sum(row[i] for i, row in enumerate(matrix))
    bits = max((log2(comb(d, k)) + k * log2(max(trace, 1) / k) for k in range(1, d + 1)), default=0.0)  # of the k-th elementary symmetric sum
    bits += d  # factors have coefficients of at most 2 ** d times as much
    primes = primes_below(1 << 31, int(bits / 30.9) + 4)
    names = ["p", "poly", "common"]

    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], []]
            for p in batch.column(0).to_pylist():
                poly = charpoly_mod(np.array([[v % p for v in row] for row in matrix], np.int64), p)
                for col, v in zip(cols, (p, poly.tolist(), gcd_with_derivative_mod(poly, p).tolist()), strict=True):
                    col.append(v)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], longs), pa.array(cols[2], longs)], names=names)

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    asked = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    rows = asked.mapInArrow(run, "p long, poly array<long>, common array<long>").collect()  # of the dimension alone
    least = min(len(r.common) for r in rows)  # a prime may make roots meet, never part them
    return remainders({r.p: r.poly for r in rows}), remainders({r.p: r.common for r in rows if len(r.common) == least})


def principal(spark: SparkSession, matrix: list[list[int]], count: int) -> tuple[list[Decimal], list[list[float]]]:
    """The largest positive eigenvalues of such a matrix, repeats counted, with unit eigenvectors; at most ``count``."""
    poly, common = characteristic(spark, matrix)
    simple = divided(poly, common)
    found = largest_roots(poly, common, count)
    if not found:
        return [], []
    # As many digits more as neighbouring roots agree in.
    edges = [r.low / 2**r.bits for r in found] + [r.high / 2**r.bits for r in found]
    narrow = min((r.high - r.low) / 2**r.bits / max(edges) for r in found)
    bits = ROOT_BITS + 2 * int(max(0.0, -log2(narrow)))
    digits = int(bits * 0.3)
    schema = "k int, value string, vectors array<array<double>>"

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                root = refined(simple, found[k], bits)
                with localcontext() as context:
                    context.prec = digits + 20
                    value = Decimal(root.low + root.high) / 2 / (Decimal(2) ** root.bits)
                vectors = null_space(matrix, value, root.times, digits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([str(value)]), pa.array([vectors], pa.list_(pa.list_(pa.float64())))], names=["k", "value", "vectors"]
                )

    asked = spark.createDataFrame([(k,) for k in range(len(found))], "k int").repartition(len(found))
    rows = sorted(asked.mapInArrow(run, schema).collect())  # at most ``count`` and one root's repeats
    values = [Decimal(r.value) for r in rows for _ in r.vectors]
    return values[:count], [v for r in rows for v in r.vectors][:count]


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates of integer vectors: exact distances from the mean, then one product."""
    away = _distances(x, model).astype(np.float64) / model.n
    return away @ (np.array(model.components).T / np.sqrt(model.values))


def _distances(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n x - S in exact integers."""
    sums = np.array(model.sums, object)
    if model.n * (int(np.abs(x).max(initial=0)) + 1) < 1 << 61 and all(abs(s) < 1 << 61 for s in model.sums):
        return model.n * x - sums.astype(np.int64)
    return model.n * x.astype(object) - sums


def fit(rows: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Whitening fitted to each distinct integer vector once, in the commonest length (ties: the longest); see ``transform``.

    Eigenvalues of zero have no component; without vectors, or with one alone, there are none at all.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "whitening")
    distinct = rows.select(integers(rows[vector_col]).alias("x")).filter("x is not null").distinct()
    distinct = scratch.cut(distinct, "fit")
    sizes = distinct.groupBy(F.size("x").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    dims = sizes[0].dims if sizes else 0
    if not dims:
        return Whitening(0, [])
    distinct = distinct.filter(F.size("x") == dims)
    n, total, products = _sums(distinct, dims)
    sums = [t + n * OFFSET for t in total]
    scatter = [[n * products[i][j] - total[i] * total[j] for j in range(dims)] for i in range(dims)]  # n * n times the covariance
    unit = gcd(*[v for row in scatter for v in row])
    if not unit:
        return Whitening(n, sums)
    reduced = [[v // unit for v in row] for row in scatter]
    values, vectors = principal(spark, reduced, components)
    trace = sum(row[i] for i, row in enumerate(reduced))
    model = Whitening(n, sums, vectors, [float(v * unit / n / n) for v in values], [float(v / trace) for v in values])
    return Whitening(n, sums, vectors, model.values, model.explained, _identity_error(distinct, model))


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    k = len(model.values)

    def run(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = _projected(_matrix(batch.column(0), model.dims), model)
            total += z.sum(axis=0)
            products += z.T @ z
        entries = [*[(i, -1, total[i]) for i in range(k)], *[(i, j, products[i, j]) for i in range(k) for j in range(k)]]
        cols = [pa.array([e[c] for e in entries], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["i", "j", "s"])

    rows = distinct.select("x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()  # a row per two components
    found = {(r.i, r.j): r.s / model.n for r in rows}
    return max(abs(found[i, j] - found[i, -1] * found[j, -1] - (i == j)) for i in range(k) for j in range(k))


def transform(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: the id, ``deviation`` (the sum of (n x - S)^2 over dimensions, exact; null beyond a long) and ``whitened``, an array.

    Rows whose vector is null, has null or non-finite entries or another length than the fitted ones are left out. Repeated
    rows, null ids too, get the same result each. Without components, as for an empty table, there are no rows.
    """
    schema = T.StructType(
        [T.StructField(id_col, rows.schema[id_col].dataType), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )
    kept = rows.select(rows[id_col].alias("id"), integers(rows[vector_col]).alias("x")).filter(F.size("x") == model.dims)
    if not model.values:
        kept = kept.limit(0)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), model.dims)
            away = _distances(x, model)
            if away.dtype != object and int(np.abs(away).max(initial=0)) ** 2 * model.dims >= 1 << 63:
                away = away.astype(object)
            deviation = [v if v < 1 << 63 else None for v in map(int, (away * away).sum(axis=1))]
            z = _projected(x, model)
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), whitened], names=schema.names)

    return kept.mapInArrow(run, schema)
