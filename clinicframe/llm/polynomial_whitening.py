"""Whitening of embeddings whose variances are exact roots of a characteristic polynomial.

Components become whole numbers x, and all that follows up to the eigenvectors is exact.
Each distinct vector enters once. Tasks add up its products with itself, so the driver
gets d * (d + 3) / 2 + 1 sums for d dimensions, whatever the number of rows; they give the
scatter matrix M = n * sum(x x') - S S' = n^2 * covariance, centred and without rounding.
The characteristic polynomial of M is found modulo as many primes as its coefficients
need: each task brings M to Hessenberg form for its primes and reads the polynomial off
by recurrence; Chinese remaindering puts the coefficients together. All roots are real,
so the number above any point is the number of sign changes of the polynomial shifted
there. Bisection by that number isolates the largest roots and then narrows them to
``ROOT_BITS`` relative bits. An eigenvector is the limit of inverse iteration: M minus the
root is eliminated with full pivoting in fixed point down to as many pivots as the
isolated root stands for, and substitution backwards from these gives its null space.
Roots closer than ``ROOT_BITS`` count as one root with a null space of several dimensions.

Nulls: vectors that are null, empty, or hold null or non-finite components are dropped; a
null vec_id is returned as null. The fit needs one length: only vectors of the length that
most rows have are kept (of lengths held equally often the longest). Rows that repeat are
returned as often as they come. A component without variance has ``explained`` 0 and
``whitened`` null, and takes no part in ``identity_error``, which is 0 if none has any. A
``deviation`` beyond a long is null; ``deviation_text`` always has its digits. Components
are cut off at the ends of a long. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import isqrt, sqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clinicframe.llm.common import identifier
from clinicframe.llm.vectors import I64_MAX, PIECES, added, common_length, largest, matrix, pieces, whole_vectors
from clinicframe.session import ensure_checkpoint_dir

SCALE = 256
COMPONENTS = 4
ROOT_BITS = 192
#: Rows and bits multiplied at once: sums of 2^12 products of 2^40 are exact in doubles.
_ROWS, _BITS = 4096, 20


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x of whole numbers, as Python numbers. Numbers beyond 20 bits are multiplied in pieces."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for start in range(0, len(x), _ROWS):
        rest, digits = x[start : start + _ROWS], []
        while largest(rest) >= 1 << _BITS:
            digits.append((rest & ((1 << _BITS) - 1)).astype(float))
            rest = rest >> _BITS
        digits.append(rest.astype(float))
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a.T @ b).astype(np.int64).astype(object) << (_BITS * (i + j))
    return total


def _sums(frames: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Products of all rows of a task, with a column of ones that makes the sums and the count."""
    total = np.zeros((length + 1, length + 1), object)
    for frame in frames:
        x = matrix(frame["x"], length)
        total += exact_products(np.hstack([x, np.ones((len(x), 1), np.int64)]))
    rows = [(i, j, *part) for i in range(length + 1) for j in range(i, length + 1) for part in pieces(int(total[i, j]))]
    yield pd.DataFrame(rows, columns=["i", "j", "place", "piece"])


class Scatter(NamedTuple):
    """Number of vectors, their sums by dimension, and n^2 times their covariance; all exact."""

    n: int
    sums: list[int]
    matrix: np.ndarray


def scatter(distinct: DataFrame, length: int) -> Scatter:
    parts = distinct.select("x").mapInPandas(lambda f: _sums(f, length), f"i int, j int, {PIECES}")
    total = np.zeros((length + 1, length + 1), object)
    for (i, j), value in added(parts, "i", "j").items():
        total[i, j] = total[j, i] = value
    n, sums = total[length, length], total[length, :length]
    return Scatter(n, list(sums), n * total[:length, :length] - np.multiply.outer(sums, sums))


def _is_prime(n: int) -> bool:
    """Exact below 3 * 10^9 with these bases."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    twos = ((n - 1) & (1 - n)).bit_length() - 1
    for base in (2, 3, 5, 7):
        y = pow(base, (n - 1) >> twos, n)
        if y not in (1, n - 1) and not any((y := y * y % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes under 2^31 whose product exceeds the bound."""
    found, product, candidate = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def hessenberg(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Matrices similar to a[k] modulo p[k] that are zero below the first subdiagonal."""
    a, d, every = a.copy(), a.shape[1], np.arange(len(a))
    wide = p[:, None, None]
    for k in range(d - 2):
        nonzero = a[:, k + 1 :, k] != 0
        pivot = np.where(nonzero.any(axis=1), nonzero.argmax(axis=1), 0) + k + 1
        a[every, k + 1], a[every, pivot] = a[every, pivot], a[every, k + 1]
        a[every, :, k + 1], a[every, :, pivot] = a[every, :, pivot], a[every, :, k + 1]
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(a[:, k + 1, k], p)], np.int64)
        factor = a[:, k + 2 :, k] * inverse[:, None] % p[:, None]
        a[:, k + 2 :] = (a[:, k + 2 :] - factor[:, :, None] * a[:, k + 1][:, None, :]) % wide
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * factor[:, None, :] % wide).sum(axis=2)) % p[:, None]
    return a


def polynomials(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients, constant first, of det(t - a[k]) modulo p[k]."""
    h, d = hessenberg(a, p), a.shape[1]
    mod = p[:, None]
    out = np.zeros((d + 1, len(p), d + 1), np.int64)
    out[0, :, 0] = 1
    for k in range(1, d + 1):
        own = out[k]
        own[:, 1:] = out[k - 1, :, :-1]
        own -= h[:, k - 1, k - 1][:, None] * out[k - 1] % mod
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            own -= (below * h[:, i - 1, k - 1] % p)[:, None] * out[i - 1] % mod
        own %= mod
    return out[d]


def _residues(frames: Iterator[pd.DataFrame], entries: list[list[int]]) -> Iterator[pd.DataFrame]:
    exact = np.array(entries, object).reshape(len(entries), len(entries))
    for frame in frames:
        p = frame["prime"].to_numpy(np.int64)
        if len(p):
            a = np.stack([(exact % int(q)).astype(np.int64) for q in p])
            yield pd.DataFrame({"prime": p, "residues": list(polynomials(a, p))})


def remaindered(residues: np.ndarray, primes: list[int]) -> list[int]:
    """The numbers of smallest magnitude with these residues: one row a prime, one column a number."""
    values, product = [0] * residues.shape[1], 1
    for p, row in zip(primes, residues):
        inverse = pow(product, -1, p)
        values = [v + product * ((int(r) - v) * inverse % p) for v, r in zip(values, row)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def characteristic_polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Exact coefficients, constant first, of det(t - m) for a whole matrix without negative eigenvalues.

    No coefficient exceeds the product of (1 + eigenvalue), and that is largest for equal eigenvalues.
    """
    d, trace = len(m), sum(m.diagonal())
    primes = primes_for(2 * (trace // d + 2) ** d)
    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks)
    entries = [[int(v) for v in row] for row in m]
    rows = {r["prime"]: r["residues"] for r in table.mapInPandas(lambda f: _residues(f, entries), "prime long, residues array<long>").collect()}
    return remaindered(np.array([rows[p] for p in primes]), primes)


def roots_above(coefficients: list[int], point: Fraction) -> int:
    """The number of roots beyond a point of a polynomial all of whose roots are real: sign changes once it is shifted there."""
    d, down = len(coefficients) - 1, point.denominator
    c = [v * down ** (d - i) for i, v in enumerate(coefficients)]
    for start in range(d):
        for i in range(d - 1, start - 1, -1):
            c[i] += point.numerator * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


class Root(NamedTuple):
    value: Fraction
    times: int


def largest_roots(coefficients: list[int], k: int) -> list[Root]:
    """The positive roots from the largest on, until there are k by multiplicity; each from below within ``ROOT_BITS`` relative bits."""
    top = Fraction(1 << max(1, (1 - coefficients[-2]).bit_length()))  # beyond the trace
    found: list[Root] = []
    waiting = [(Fraction(0), top, roots_above(coefficients, Fraction(0)), 0)]
    while waiting:
        low, high, above_low, above_high = waiting.pop()
        if above_low == above_high or above_high >= k:
            continue
        if low and (high - low) * (1 << ROOT_BITS) <= low:
            found.append(Root(low, above_low - above_high))
        elif above_low - above_high == 1 and low:
            found.append(Root(_narrowed(coefficients, low, high), 1))
        else:
            middle = (low + high) / 2
            above = roots_above(coefficients, middle)
            waiting += [(low, middle, above_low, above), (middle, high, above, above_high)]
    return found


def _narrowed(coefficients: list[int], low: Fraction, high: Fraction) -> Fraction:
    """The only root in (low, high], by the sign of the polynomial."""

    def sign(point: Fraction) -> int:
        value, scale = 0, 1
        for c in reversed(coefficients):
            value = value * point.numerator + c * scale
            scale *= point.denominator
        return (value > 0) - (value < 0)

    at_high = sign(high)
    if not at_high:
        return high
    while (high - low) * (1 << ROOT_BITS) > low:
        middle = (low + high) / 2
        at_middle = sign(middle)
        if not at_middle:
            return middle
        low, high = (low, middle) if at_middle == at_high else (middle, high)
    return low


def null_space(m: np.ndarray, root: Root) -> np.ndarray:
    """Unit eigenvectors of a root, one a row: the limit of inverse iteration.

    Eliminated with full pivoting, m minus the root leaves as many negligible pivots as
    the root counts; inverse iteration would divide by these last, so that all else vanishes.
    """
    d, digits = len(m), max(ROOT_BITS + 64, root.value.denominator.bit_length())
    a = (m << digits) - np.diag([int(root.value * (1 << digits))] * d)
    columns, rank = np.arange(d), d - root.times
    for k in range(rank):
        i, j = divmod(int(np.abs(a[k:, k:]).argmax()), d - k)
        a[[k, k + i]], columns[[k, k + j]] = a[[k + i, k]], columns[[k + j, k]]
        a[:, [k, k + j]] = a[:, [k + j, k]]
        a[k + 1 :, k + 1 :] -= np.multiply.outer(a[k + 1 :, k], a[k, k + 1 :]) // a[k, k]
    out = np.zeros((root.times, d))
    for f in range(root.times):
        z = np.zeros(d, object)
        z[rank + f] = 1 << digits
        for i in range(rank - 1, -1, -1):
            z[i] = -(int((a[i, i + 1 :] * z[i + 1 :]).sum()) // a[i, i])
        size = isqrt(int((z * z).sum()))
        out[f, columns] = [v / size for v in z]
    out = np.linalg.qr(out.T)[0].T if root.times > 1 else out
    strongest = out[np.arange(len(out)), np.abs(out).argmax(axis=1)]
    return out * np.sign(strongest)[:, None]


class Whitening(NamedTuple):
    """Component vectors (one a row, zero past the rank), roots of M that belong to them, and what they centre on."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    spread: list[float]
    explained: list[float]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in double precision, from exact differences."""
        if self.n * largest(x) + max(map(abs, self.sums)) < 1 << 62:
            return (self.n * x - np.array(self.sums, np.int64)).astype(float)
        return (self.n * x.astype(object) - np.array(self.sums, object)).astype(float)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (self.centred(x) @ self.vectors.T) / np.array(self.spread)

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n * x - S)^2) = n^2 sum(x^2) - 2 n sum(x S) + sum(S^2), exact for numbers of any size."""
        constant = sum(s * s for s in self.sums)
        if largest(x) ** 2 * x.shape[1] < 1 << 62 and largest(x) * sum(map(abs, self.sums)) < 1 << 62:
            squares, mixed = ((x * x).sum(axis=1), x @ np.array(self.sums, np.int64))
        else:
            wide = x.astype(object)
            squares, mixed = ((wide * wide).sum(axis=1), wide @ np.array(self.sums, object))
        return [self.n * (self.n * int(a) - 2 * int(b)) + constant for a, b in zip(squares, mixed)]


def fitted(spark: SparkSession, found: Scatter, k: int = COMPONENTS) -> Whitening:
    """Components of the exact scatter matrix."""
    d, trace = len(found.sums), sum(found.matrix.diagonal())
    k = min(k, d)
    vectors, spread, explained = np.zeros((k, d)), [0.0] * k, [0.0] * k
    at = 0
    for root in largest_roots(characteristic_polynomial(spark, found.matrix), k) if trace else []:
        for row in null_space(found.matrix, root)[: k - at]:
            vectors[at], spread[at], explained[at] = row, sqrt(root.value), float(root.value / trace)
            at += 1
    return Whitening(found.n, found.sums, vectors, spread, explained)


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened fit list is from the identity, over the components that vary."""
    k = sum(s > 0 for s in model.spread)
    if not k:
        return 0.0
    length = len(model.sums)

    def turned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(model.whitened(matrix(frame["x"], length))[:, :k], columns=[f"w{i}" for i in range(k)])

    rows = distinct.select("x").mapInPandas(turned, ", ".join(f"w{i} double" for i in range(k)))
    means = [F.avg(f"w{i}").alias(f"m{i}") for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*means, *[F.avg(F.col(f"w{i}") * F.col(f"w{j}")).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"p{i}_{j}"] - got[f"m{i}"] * got[f"m{j}"] - (i == j)) for i, j in pairs)


SCHEMA = "vec_order long, component int, n long, deviation long, whitened double, explained double, deviation_text string"


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """One row for each kept vector and component: its whitened value and what the fit says."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = whole_vectors(vectors, scale)
    length = common_length(rows)
    rows = rows.filter(F.col("dim") == length)
    columns = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text")
    if not length:
        return spark.createDataFrame([], SCHEMA.replace("vec_order", "vec_id") + ", identity_error double").select(*columns)
    distinct = rows.select("x").distinct().checkpoint()
    model = fitted(spark, scatter(distinct, length), components)
    error = identity_error(distinct, model)

    def out(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(model.spread)
        for frame in frames:
            x = matrix(frame["x"], length)
            exact = model.deviations(x)
            times = lambda values: np.repeat(np.array(values, object), k)
            white = model.whitened(x).reshape(-1)
            yield pd.DataFrame({
                "vec_order": np.repeat(frame["vec_order"].to_numpy(), k), "component": np.tile(np.arange(1, k + 1), len(x)), "n": model.n,
                "deviation": pd.array(times([v if v <= I64_MAX else None for v in exact]), "Int64"),
                "whitened": pd.Series(white).astype(object).where(np.tile(np.array(model.spread) > 0, len(x)), None),
                "explained": np.tile(model.explained, len(x)), "deviation_text": times([str(v) for v in exact]),
            })

    found = rows.select("vec_order", "x").mapInPandas(out, SCHEMA).withColumn("identity_error", F.lit(error))
    return found.select(identifier("vec_order").alias("vec_id"), *columns[1:])
