"""Whitened principal components of a table of vectors, from exact integers.

Entries become whole numbers, so the scatter matrix of the whole table is a sum of whole
numbers: tasks hand on exact totals per matrix entry and Spark adds them up. What follows
depends on the dimension alone:

* The characteristic polynomial of the integer scatter is computed modulo many primes
  (Hessenberg reduction, one prime per row of a Spark job) and put together by Chinese
  remaindering; the coefficients are exact.
* All its roots are real, so the sign changes of the polynomial moved to t count its roots
  above t, repeated ones as often as they occur. Bisection on these counts isolates roots,
  signs refine them to BITS binary digits.
* A component is found by inverse iteration in the null space of scatter - root, in fixed
  point of several hundred bits. Equal roots share a space; any basis of it will do.

A last pass over the vectors projects them.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import lru_cache
from math import comb, gcd, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planmatch.functions.predicates import named
from planmatch.llm.batches import arrow_map
from planmatch.sources.storage import materialise

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
# Binary digits to which roots are refined.
BITS = 192
# Rows and digit size of one exact product in doubles: 2^12 x 2^19 x 2^19 < 2^53.
BLOCK = 4096
DIGIT = 20
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole_rows(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(rows, vectors) of the usable vectors by length: `rows[length]` are places in the
    batch, the vectors whole numbers floor(1024 c) + 100000, held inside a long."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    entries = pc.fill_null(pc.cast(column.flatten(), pa.float64()), float("nan"))
    entries = np.asarray(entries)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    usable = (size > 0) & (bad[ends] == bad[ends - size])
    rows, vectors = {}, {}
    for length in np.unique(size[usable]):
        at = np.flatnonzero(usable & (size == length))
        cells = entries[(ends - size)[at][:, None] + np.arange(length)]
        cells = np.floor(SCALE * cells)
        inside = np.abs(cells) < 2.0**62
        values = np.where(inside, cells, 0).astype(np.int64) + SHIFT
        values[~inside] = np.where(cells[~inside] < 0, *_LONG)
        rows[int(length)], vectors[int(length)] = at, values
    return rows, vectors


@dataclass(frozen=True)
class Fit:
    """Everything the projection needs: `n` vectors with sums `sums`, unit `axes` (one per
    row), variances `variance` along them and the total variance `trace`."""

    n: int
    sums: tuple[int, ...]
    axes: np.ndarray
    variance: np.ndarray
    explained: np.ndarray


def vector_sums(vectors: DataFrame, vector: str) -> tuple[int, list[int]]:
    """(n, sums) over the usable vectors of the most frequent length (of equals the
    largest); (0, []) where there is none."""

    def add(batch):
        out = []
        _, of = whole_rows(batch.column(0))
        for length, x in of.items():
            # Halves of a long: their sums over a batch stay exact.
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            out += [(length, j, len(x), int(high[j]), int(low[j])) for j in range(length)]
        return list(zip(*out)) or [()] * 5

    parts = arrow_map(vectors.select(named(vector)), add, "length int, j int, n bigint, high bigint, low bigint")
    wide = "decimal(38,0)"
    totals = materialise(
        parts.groupBy("length", "j").agg(
            F.sum("n").alias("n"), F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low")
        ),
        "sums",
    )
    best = totals.orderBy(F.desc("n"), F.desc("length")).first()
    if best is None:
        return 0, []
    rows = totals.where(F.col("length") == best["length"]).orderBy("j").collect()  # a row per dimension
    return best["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows]


def digits(z: np.ndarray) -> list[np.ndarray]:
    """Signed digits of DIGIT bits, lowest first, as doubles."""
    out = []
    while True:
        low = ((z + (1 << (DIGIT - 1))) & ((1 << DIGIT) - 1)) - (1 << (DIGIT - 1))
        out.append(low.astype(np.float64))
        z = (z - low) >> DIGIT
        if not z.any():
            return out


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """x - centre; as Python numbers where a long would not hold it."""
    middle = np.array(centre, np.int64)
    if len(x) and max(int(np.abs(x // 2).max()), int(np.abs(middle // 2).max())) >= 1 << 60:
        return x.astype(object) - middle.astype(object)
    return x - middle


def scatter(vectors: DataFrame, vector: str, n: int, sums: list[int]) -> list[list[int]]:
    """n² V in whole numbers, V the covariance over all usable vectors (divisor n)."""
    d = len(sums)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    upper = np.triu_indices(d)

    def add(batches):
        held: dict[int, np.ndarray] = {}
        steps = 0

        def flushed():
            for power, total in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()),
                     pa.array(np.full(len(upper[0]), power), pa.int32()), pa.array(total[upper], pa.int64())],
                    names=["i", "j", "power", "v"],
                )

        for batch in batches:
            x = whole_rows(batch.column(0))[1].get(d)
            for at in range(0, 0 if x is None else len(x), BLOCK):
                parts = digits(centred(x[at : at + BLOCK], centre))
                for a, left in enumerate(parts):
                    for b in range(a + 1):
                        product = (left.T @ parts[b]).astype(np.int64)
                        if a != b:
                            product = product + product.T
                        held[a + b] = held.get(a + b, 0) + product
                steps += 2 * len(parts)
                if steps >= 256:  # totals stay far inside a long
                    yield from flushed()
                    held, steps = {}, 0
        yield from flushed()

    parts = vectors.select(named(vector)).mapInArrow(add, "i int, j int, power int, v bigint")
    totals = parts.groupBy("i", "j", "power").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    sums_of_products = [[0] * d for _ in range(d)]
    for r in totals.collect():  # d (d + 1) / 2 rows for each digit of a product
        sums_of_products[r["i"]][r["j"]] += int(r["v"]) << (DIGIT * r["power"])
    rest = [s - n * m for s, m in zip(sums, centre)]
    full = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            full[i][j] = full[j][i] = n * sums_of_products[i][j] - rest[i] * rest[j]
    return full


# --- the characteristic polynomial ---------------------------------------------------


@lru_cache(maxsize=None)
def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 2^32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        if base % n == 0:
            continue
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Primes below 2^31, falling, whose product exceeds `bound`."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo p, constant first: the matrix is brought to
    Hessenberg form by similarity, then leading minors follow one from the other."""
    h, d = matrix.copy(), len(matrix)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factor = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factor[:, None] * h[k] % p) % p
        # Sum of d products below p each: added up one reduced product at a time.
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factor % p).sum(axis=1)) % p
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for m in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = minors[m - 1, :-1]
        row = (row - int(h[m - 1, m - 1]) * minors[m - 1]) % p
        below, scales = 1, []
        for i in range(m - 1, 0, -1):
            below = below * int(h[i, i - 1]) % p
            scales.append(int(h[i - 1, m - 1]) * below % p)
        if scales:
            row = (row - (np.array(scales, np.int64)[:, None] * minors[m - 2 :: -1][: len(scales)] % p).sum(axis=0)) % p
        minors[m] = row
    return [int(c) for c in minors[d]]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - matrix) for a symmetric matrix of whole numbers without
    negative eigenvalues, constant first. Exact."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # Elementary symmetric functions of such eigenvalues are largest when all are equal.
    bound = max(comb(d, k) * -(-(trace**k) // d**k) for k in range(d + 1))
    primes = primes_beyond(bound)

    def reduce(batch):
        out = []
        for p in batch.column(0).to_pylist():
            residues = np.array([[v % p for v in row] for row in matrix], np.int64)
            out.append(polynomial_modulo(residues, p))
        return [batch.column(0), out]

    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    asked = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(tasks, "p")
    residues = {r["p"]: r["c"] for r in arrow_map(asked, reduce, "p bigint, c array<bigint>").collect()}
    modulus = 1
    for p in primes:
        modulus *= p
    weights = {p: modulus // p * pow(modulus // p, -1, p) for p in primes}
    out = []
    for k in range(d + 1):
        size = sum(weights[p] * (residues[p][k] if (d - k) % 2 == 0 else -residues[p][k]) for p in primes) % modulus
        out.append(size if (d - k) % 2 == 0 else -size)
    return out


# --- its roots ------------------------------------------------------------------------


@dataclass(frozen=True)
class Root:
    """`times` roots between low / 2^places and high / 2^places."""

    low: int
    high: int
    places: int
    times: int


class RealRooted:
    """A monic integer polynomial all of whose roots are real and not negative."""

    def __init__(self, coefficients: list[int]):
        self.zeros = next(k for k, c in enumerate(coefficients) if c)
        self.c = coefficients[self.zeros :]
        self._counts: dict[tuple[int, int], int] = {}

    def _scaled(self, places: int) -> list[int]:
        """Roots 2^places times as large."""
        d = len(self.c) - 1
        return [c << places * (d - k) for k, c in enumerate(self.c)]

    def above(self, t: int, places: int) -> int:
        """How many roots, repeated ones included, exceed t / 2^places (t not negative)."""
        while t and t % 2 == 0 and places:
            t, places = t // 2, places - 1
        if (t, places) not in self._counts:
            moved, d = self._scaled(places), len(self.c) - 1
            for i in range(d):
                for k in range(d - 1, i - 1, -1):
                    moved[k] += t * moved[k + 1]
            signs = [c > 0 for c in moved if c]
            self._counts[t, places] = sum(a != b for a, b in zip(signs, signs[1:]))
        return self._counts[t, places]

    def at(self, t: int, places: int) -> int:
        """Value at t / 2^places, times a power of two."""
        value = 0
        for k, c in enumerate(reversed(self.c)):
            value = value * t + (c << places * k)
        return value

    def largest(self, most: int, bits: int) -> list[Root]:
        """The `most` largest roots with their repeats, falling; the last may carry more
        repeats than asked for. Zero roots are left out. Each is known to `bits` binary
        digits; roots that agree in all of these count as one."""
        top = max(1, -self.c[-2]).bit_length() if len(self.c) > 1 else 0  # their sum
        found: list[Root] = []
        have = 0
        while have < min(most, len(self.c) - 1):
            # The largest root not found yet lies in (low, high], `have` lie beyond.
            low, high, places = (0, found[-1].low, found[-1].places) if found else (0, 1 << top, 0)
            while not (low and self.above(low, places) == have + 1) and high - low > high >> bits:
                if high - low <= 1:
                    low, high, places = 2 * low, 2 * high, places + 1
                middle = (low + high) // 2
                if self.above(middle, places) > have:
                    low = middle
                else:
                    high = middle
            times = self.above(low, places) - have
            if times == 1:
                low, high, places = self._refined(low, high, places, bits, have % 2 == 0)
            found.append(Root(low, high, places, times))
            have += times
        return found

    def _refined(self, low: int, high: int, places: int, bits: int, beyond: bool) -> tuple[int, int, int]:
        """A simple root alone in (low, high], found by signs; `beyond` it the polynomial is
        positive or not."""
        while high - low > high >> bits:
            if high - low <= 1:
                low, high, places = 2 * low, 2 * high, places + 1
            middle = (low + high) // 2
            value = self.at(middle, places)
            if value == 0:
                grown = max(0, bits + 2 - middle.bit_length())
                return (middle << grown) - 1, middle << grown, places + grown
            if (value > 0) == beyond:
                high = middle
            else:
                low = middle
        return low, high, places


# --- components -----------------------------------------------------------------------


def _norm(v: np.ndarray) -> int:
    return isqrt(int((v * v).sum()))


def null_space(matrix: list[list[int]], root: Root, wanted: int, bits: int) -> np.ndarray:
    """`wanted` unit vectors (rows, doubles) at right angles in the space where `matrix`
    multiplies by `root`: inverse iteration in fixed point."""
    d = len(matrix)
    entry = max(1, max(abs(v) for row in matrix for v in row)).bit_length()
    point = 3 * bits + 2 * entry + root.places  # binary places
    one = 1 << point
    shift = (root.low + root.high) << (point - root.places - 1)
    a = np.array([[v << point for v in row] for row in matrix], object)
    a[np.arange(d), np.arange(d)] -= shift
    order = list(range(d))
    factors = np.zeros((d, d), object)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            factors[[k, pivot]] = factors[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            f = (a[k + 1 :, k] << point) // a[k, k]
            factors[k + 1 :, k] = f
            a[k + 1 :, k:] -= (f[:, None] * a[k, k:][None, :]) >> point

    def solved(v: np.ndarray) -> np.ndarray:
        x = v[order].copy()
        for k in range(1, d):
            x[k] -= int((factors[k, :k] * x[:k]).sum()) >> point
        for k in range(d - 1, -1, -1):
            rest = x[k] - (int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> point)
            x[k] = (rest << point) // a[k, k]
        return x

    def unit(v: np.ndarray) -> np.ndarray:
        size = _norm(v)
        return np.array([(int(c) << point) // size for c in v], object)

    axes: list[np.ndarray] = []
    for number in range(wanted):
        # Any start will do that is not at right angles to the space.
        start = [((i + 1) * (2 * number + 3) * 2654435761 % 1000003) - 500001 for i in range(d)]
        v = np.array([c << point for c in start], object)
        for _ in range(3):
            for held in axes:
                v = v - ((int((v * held).sum()) >> point) * held >> point)
            v = unit(solved(unit(v)))
        for held in axes:
            v = v - ((int((v * held).sum()) >> point) * held >> point)
        axes.append(unit(v))
    return np.array([[int(c) / one for c in v] for v in axes], np.float64)


def fit_components(spark: SparkSession, n: int, sums: list[int], full: list[list[int]], components: int, bits: int = BITS) -> Fit:
    """The largest `components` directions of positive variance. `full` is n² V."""
    d = len(sums)
    common = 0
    for row in full:
        common = gcd(common, *row)
    if not common:
        return Fit(n, tuple(sums), np.zeros((0, d)), np.zeros(0), np.zeros(0))
    matrix = [[v // common for v in row] for row in full]
    polynomial = RealRooted(characteristic_polynomial(spark, matrix))
    trace = sum(matrix[i][i] for i in range(d))
    axes, variance, explained = [], [], []
    for root in polynomial.largest(components, bits):
        wanted = min(root.times, components - len(variance))
        axes.append(null_space(matrix, root, wanted, bits))
        middle, double = root.low + root.high, 2 << root.places
        variance += [common * middle / (double * n * n)] * wanted
        explained += [middle / (double * trace)] * wanted
    return Fit(n, tuple(sums), np.concatenate(axes), np.array(variance), np.array(explained))


def projected(vectors: DataFrame, fit: Fit, key: str, vector: str) -> DataFrame:
    """(key, deviation, whitened) of every usable vector of the fitted length."""
    d, n = len(fit.sums), fit.n
    centre = [(2 * s + n) // (2 * n) for s in fit.sums]
    rest = [s - n * m for s, m in zip(fit.sums, centre)]
    scaled = (fit.axes / np.sqrt(fit.variance)[:, None]).T
    kind = vectors.schema[key].dataType.simpleString()

    def project(batch):
        rows, of = whole_rows(batch.column(1))
        if d not in of:
            return [batch.column(0).slice(0, 0), [], []]
        z = centred(of[d], centre)
        if z.dtype != object and d * (n * (int(np.abs(z).max()) + 1)) ** 2 < 1 << 63:
            deviation = pa.array(((n * z - np.array(rest, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        else:
            exact = ((n * z.astype(object) - np.array(rest, object)) ** 2).sum(axis=1)
            deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
        white = (z.astype(np.float64) - np.array([r / n for r in rest])) @ scaled
        ends = pa.array(np.arange(len(white) + 1) * white.shape[1], pa.int32())
        return [batch.column(0).take(pa.array(rows[d])), deviation, pa.ListArray.from_arrays(ends, white.ravel())]

    used = vectors.select(named(key).alias("key"), named(vector).alias("vector"))
    return arrow_map(used, project, f"key {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, components: int) -> float:
    """Largest absolute entry of the covariance of `whitened` minus the identity. The sums
    behind `covar_pop` are centred before they are multiplied."""
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    asked = [
        F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs
    ]
    found = whitened.agg(*asked).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for every usable
    vector and each of the largest `components` directions, numbered from 1.

    Vectors that are null or empty, or hold a null or an entry that is not finite, are left
    out; where lengths differ, so are those not of the most frequent one (of equals the
    largest). Entries whose whole number would leave a long are held at its end. Repeated
    rows count and are returned as often as they come; a null key is returned as it is. A
    direction without variance cannot be whitened and has no row of its own; where none has
    variance each vector has one row of component 1 with neither `whitened` nor `explained`.
    `deviation` is null beyond 38 digits. A table without usable vectors gives no rows.
    Equal variances (to BITS binary digits) share a space, of which any basis is returned.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    n, sums = vector_sums(vectors, vector)
    if not n:
        return spark.createDataFrame(
            [],
            f"key {kind}, component int, n bigint, deviation decimal(38,0), whitened double, "
            "explained double, identity_error double",
        )
    fit = fit_components(spark, n, sums, scatter(vectors, vector, n, sums), components)
    rows = projected(vectors, fit, key, vector)
    count = F.lit(n).cast("bigint").alias("n")
    if not len(fit.variance):
        nothing = F.lit(None).cast("double")
        return rows.select(
            "key", F.lit(1).alias("component"), count, "deviation",
            nothing.alias("whitened"), nothing.alias("explained"), nothing.alias("identity_error"),
        )
    rows = materialise(rows, "whitened")
    error = identity_error(rows, len(fit.variance))
    share = F.array(*[F.lit(float(e)) for e in fit.explained])
    return rows.select("key", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "key",
        (F.col("at") + 1).alias("component"),
        count,
        "deviation",
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
