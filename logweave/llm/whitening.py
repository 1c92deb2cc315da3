"""Whitening of embeddings by an exact characteristic polynomial.

Entries become integers, so the scatter matrix of all vectors is an integer
matrix that is summed without rounding: each task adds up its rows, Spark adds
the tasks' entries limb by limb. The characteristic polynomial of n times the
scatter less the sums' products (n * n times the covariance) is found modulo
many 31-bit primes, one task for each: the matrix is brought to Hessenberg form
and the polynomial read off; Chinese remaindering gives the integer
coefficients. All roots are real, so the sign changes of the polynomial's
coefficients after a shift by a (Budan and Fourier) are exactly the number of
roots above a: roots are parted by halving with that count and then refined by
sign to ``BITS`` binary places. Each component is the null vector of the matrix
less its root, by inverse iteration in fixed-point integers of ``BITS`` places;
a multiple root gives as many vectors, made orthogonal.

What passes through the driver is the square of the dimension (sums, matrix,
polynomial), whatever the number of rows. Rows are read three times (sums,
check of the whitened covariance, result) and never shuffled.

Defined results: rows whose vector is null, empty, or holds null, non-finite or
out-of-range entries (64 * c beyond +-2^61) are left out, as are vectors of
another size than the most common one (the larger of ties). Components whose
root is zero have nothing to scale and are left out: fewer vectors than
dimensions, repeated or constant rows give fewer components, one vector or an
empty table none (and then no rows in the query). Ids are never read: null and
repeated ids stay. Extra columns are carried along, and an input column named
like an output column gives way.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import col, packed, unpacked

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
BITS = 192
LIMB, LIMBS = 30, 6
RANGE = 2.0**61
OWN = ("whitened", "deviation")


# --- sums over all rows ------------------------------------------------------

def entries(df: DataFrame, vec_col: str, keep: DataFrame | None = None) -> tuple[DataFrame, int]:
    """(_row, _x) of the rows that count, ``_x`` the integers less ``OFFSET``
    (nothing below depends on it), and the dimension (0 without rows)."""
    c = col(vec_col).cast("array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * SCALE) < RANGE))
    row = packed(keep) if keep is not None and keep.columns else F.struct(F.lit(0).alias("x")).alias("_row")
    rows = df.select(row, F.when(fine, F.transform(c, lambda x: F.floor(x * SCALE))).alias("_x")).filter(
        F.size("_x") > 0)
    most = rows.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most["d"] if most else 0
    return rows.filter(F.size("_x") == d), d


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    x = batch.column("_x")
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), d)


def products(x: np.ndarray) -> np.ndarray:
    """x' x in exact integers: through doubles in blocks whose sums stay below 2^53."""
    high = int(np.abs(x).max(initial=0))
    block = 2**53 // max(high * high, 1)
    if block < 16:
        x = x.astype(object)
        return x.T @ x
    total = np.zeros((x.shape[1],) * 2, object)
    for k in range(0, len(x), block):
        y = x[k:k + block].astype(np.float64)
        total = total + (y.T @ y).astype(np.int64)
    return total


def limbs(value: int) -> list[int]:
    """A signed integer as longs of ``LIMB`` bits each, lowest first; they can be summed one by one."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    return [sign * (value >> (LIMB * k) & (2**LIMB - 1)) for k in range(LIMBS - 1)] + [
        sign * (value >> (LIMB * (LIMBS - 1)))]


def _moments(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scatter = 0, np.zeros(d, object), np.zeros((d, d), object)
        for batch in batches:
            x = _matrix(batch, d)
            n += len(x)
            sums = sums + x.sum(0, dtype=object)
            scatter = scatter + products(x)
        i, j = np.triu_indices(d)
        values = [n, *sums, *scatter[i, j]]
        cut = np.array([limbs(int(v)) for v in values], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), *map(pa.array, cut.T)],
                                         names=["at", *(f"l{k}" for k in range(LIMBS))])
    return run


def moments(rows: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, scatter) over all rows, exact."""
    names = [f"l{k}" for k in range(LIMBS)]
    parts = rows.select("_x").mapInArrow(_moments(d), "at int, " + ", ".join(f"{k} bigint" for k in names))
    found = {r["at"]: sum(r[k] << (LIMB * p) for p, k in enumerate(names))
             for r in parts.groupBy("at").agg(*[F.sum(k).alias(k) for k in names]).collect()}
    n, sums = found.get(0, 0), [found.get(1 + k, 0) for k in range(d)]
    scatter = [[0] * d for _ in range(d)]
    for at, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True), start=1 + d):
        scatter[i][j] = scatter[j][i] = found.get(at, 0)
    return n, sums, scatter


# --- characteristic polynomial -----------------------------------------------

def is_prime(n: int) -> bool:
    """Miller and Rabin with bases that decide every n below 3 * 10^9."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    s = ((n - 1) & (1 - n)).bit_length() - 1
    return all(pow(b, (n - 1) >> s, n) == 1 or any(pow(b, (n - 1) >> k, n) == n - 1 for k in range(1, s + 1))
               for b in (2, 3, 5, 7))


def primes_for(bits: int) -> list[int]:
    """Primes below 2^31, largest first, whose product has more than ``bits`` bits."""
    out, product, n = [], 1, 2**31 - 1
    while product.bit_length() <= bits:
        if is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def polynomial_mod(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients (lowest first) of det(x I - matrix) modulo p."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(h)
    for k in range(1, d - 1):
        pivot = np.flatnonzero(h[k:, k - 1])
        if not len(pivot):
            continue
        if pivot[0]:
            other = k + pivot[0]
            h[[k, other]] = h[[other, k]]
            h[:, [k, other]] = h[:, [other, k]]
        u = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - u[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * u % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        weight, product = np.zeros(k, np.int64), 1
        weight[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            product = product * int(h[i + 1, i]) % p
            weight[i] = int(h[i, k - 1]) * product % p
        polys[k] = (polys[k] - (weight[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of det(x I - matrix), lowest first; the matrix is
    symmetric with no negative root."""
    d = len(matrix)
    # coefficient k is a sum of products of roots, which add up to the trace
    primes = primes_for(d * (sum(matrix[k][k] for k in range(d)) + 1).bit_length() + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                found = polynomial_mod(matrix, primes[k])
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([found.tolist()], pa.list_(pa.int64()))],
                                                 names=["id", "found"])
    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rest = {r["id"]: r["found"] for r in
            spark.range(0, len(primes), 1, tasks).mapInArrow(run, "id bigint, found array<bigint>").collect()}
    product = math.prod(primes)
    lift = [(product // p) * pow(product // p, -1, p) for p in primes]
    out = []
    for k in range(d + 1):
        v = sum(rest[i][k] * lift[i] for i in range(len(primes))) % product
        out.append(v - product if 2 * v > product else v)
    return out


# --- roots -------------------------------------------------------------------

def roots_above(poly: list[int], a: int) -> int:
    """Number of roots above ``a`` of a polynomial whose roots are all real."""
    c = list(poly)
    for k in range(len(c) - 1):
        for i in range(len(c) - 2, k - 1, -1):
            c[i] += a * c[i + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def value_at(poly: list[int], a: int) -> int:
    v = 0
    for c in reversed(poly):
        v = v * a + c
    return v


def top_roots(poly: list[int], count: int, bits: int = BITS) -> list[tuple[int, int]]:
    """The largest ``count`` positive roots as (root * 2^bits, multiplicity),
    falling; roots closer than 2^-bits count as one."""
    d = len(poly) - 1
    scaled = [c << (bits * (d - k)) for k, c in enumerate(poly)]
    # roots add up to minus the second coefficient
    top = ((-poly[d - 1] if d else 0) + 1) << bits
    out: list[tuple[int, int]] = []
    spans = [(0, top, roots_above(scaled, 0), 0)]  # (low, high], roots above low and above high
    while spans and sum(m for _, m in out) < count:
        low, high, above_low, above_high = spans.pop()
        m = above_low - above_high
        if not m:
            continue
        if m == 1:
            # one root: the polynomial is positive above an even number of roots
            sign = 1 if above_high % 2 == 0 else -1
            while high - low > 1:
                mid = (low + high) >> 1
                low, high = (low, mid) if value_at(scaled, mid) * sign >= 0 else (mid, high)
            out.append((high, 1))
        elif high - low == 1:
            out.append((high, m))
        else:
            mid = (low + high) >> 1
            above = roots_above(scaled, mid)
            spans += [(low, mid, above_low, above), (mid, high, above, above_high)]
    return out


# --- components --------------------------------------------------------------

def _unit(v: np.ndarray, bits: int) -> np.ndarray:
    return np.array([(x << bits) for x in v], object) // max(math.isqrt(int(sum(x * x for x in v))), 1)


def null_vectors(matrix: list[list[int]], root: int, m: int, bits: int = BITS) -> np.ndarray:
    """``m`` unit vectors (rows, doubles) of the null space of matrix - root,
    the root given times 2^bits: elimination and inverse iteration in integers
    of ``bits`` binary places."""
    d = len(matrix)
    a = np.array([[v << bits for v in row] for row in matrix], object).reshape(d, d)
    a[np.diag_indices(d)] -= root
    factors = []
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda r: abs(a[k + r, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        if not a[k, k]:
            a[k, k] = 1
        f = (a[k + 1:, k] << bits) // a[k, k] if k + 1 < d else np.empty(0, object)
        if len(f):
            a[k + 1:, k:] -= (f[:, None] * a[k, k:]) >> bits
        factors.append((pivot, f))
    rng = random.Random(d)
    vectors = [_unit(np.array([rng.randint(-2**40, 2**40) for _ in range(d)], object), bits) for _ in range(m)]
    for _ in range(3):
        done: list[np.ndarray] = []
        for v in vectors:
            v = v.copy()
            for k, (pivot, f) in enumerate(factors):
                if pivot != k:
                    v[[k, pivot]] = v[[pivot, k]]
                if len(f):
                    v[k + 1:] -= (f * v[k]) >> bits
            for k in range(d - 1, -1, -1):
                v[k] = ((v[k] - (int((a[k, k + 1:] * v[k + 1:]).sum() >> bits) if k + 1 < d else 0)) << bits) // a[k, k]
            v = _unit(v, bits)
            for other in done:
                v = v - ((other * int((other * v).sum() >> bits)) >> bits)
            done.append(_unit(v, bits))
        vectors = done
    return np.array([[float(Fraction(int(x), 1 << bits)) for x in v] for v in vectors])


def components(spark: SparkSession, matrix: list[list[int]], count: int, bits: int = BITS) -> tuple[list[int], np.ndarray]:
    """Roots (times 2^bits, falling, none zero) and unit vectors (rows) of the
    first ``count`` components; each root's vectors are one task's work."""
    roots = top_roots(characteristic(spark, matrix), count, bits)
    if not roots:
        return [], np.empty((0, len(matrix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                v = null_vectors(matrix, *roots[k], bits)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([v.ravel().tolist()], pa.list_(pa.float64()))],
                                                 names=["id", "v"])
    tasks = min(len(roots), 4 * spark.sparkContext.defaultParallelism)
    found = {r["id"]: r["v"] for r in
             spark.range(0, len(roots), 1, tasks).mapInArrow(run, "id bigint, v array<double>").collect()}
    vectors = np.array([x for k in range(len(roots)) for x in found[k]]).reshape(-1, len(matrix))[:count]
    return [root for root, m in roots for _ in range(m)][:count], vectors


# --- the operator ------------------------------------------------------------

class Whitener:
    """A fitted whitening: ``n``, ``sums`` (less OFFSET), ``explained`` and the
    vectors, ready for ``apply``."""

    def __init__(self, spark: SparkSession, rows: DataFrame, d: int, count: int):
        self.d = d
        self.n, self.sums, scatter = moments(rows, d) if d else (0, [], [])
        matrix = [[self.n * scatter[i][j] - self.sums[i] * self.sums[j] for j in range(d)] for i in range(d)]
        trace = sum(matrix[k][k] for k in range(d))
        roots, self.vectors = components(spark, matrix, min(count, d)) if trace else ([], np.empty((0, d)))
        self.explained = [float(Fraction(r, trace << BITS)) for r in roots]
        # the root of the covariance is the matrix's over n * n
        self.scale = [math.sqrt(Fraction(r, self.n * self.n << BITS)) for r in roots]

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(whitened, deviation) of integer vectors."""
        high = (int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) // max(self.n, 1) + 1) * 2 * self.n
        if self.d * high * high >= 2**63:
            x = x.astype(object)
        z = x * self.n - np.array(self.sums, x.dtype)
        deviation = (z * z).sum(1).tolist()
        return (z.astype(np.float64) / self.n) @ self.vectors.T / np.array(self.scale), deviation

    def apply(self, rows: DataFrame) -> DataFrame:
        """``_row``, whitened array<double> and deviation decimal(38, 0)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                w, deviation = self.whiten(_matrix(batch, self.d))
                offsets = pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), pa.ListArray.from_arrays(offsets, pa.array(w.ravel(), pa.float64())),
                     pa.array(list(map(str, deviation)), pa.string())], names=["_row", "whitened", "deviation"])
        kind = rows.schema["_row"].dataType.simpleString()
        return rows.mapInArrow(run, f"_row {kind}, whitened array<double>, deviation string").withColumn(
            "deviation", F.col("deviation").cast("decimal(38,0)"))

    def identity_error(self, rows: DataFrame) -> float:
        """Largest absolute entry of the whitened rows' covariance less the
        identity, summed over all rows."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = len(self.scale)
            sums, square = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                w, _ = self.whiten(_matrix(batch, self.d))
                sums += w.sum(0)
                square += w.T @ w
            values = np.concatenate([sums, square.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)],
                                             names=["at", "v"])
        k = len(self.scale)
        parts = rows.select("_x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
        found = np.zeros(k + k * k)
        for r in parts.collect():
            found[r["at"]] = r["v"]
        mean = found[:k] / self.n
        cov = found[k:].reshape(k, k) / self.n - np.outer(mean, mean)
        return float(np.abs(cov - np.eye(k)).max(initial=0.0))


def whiten(df: DataFrame, *, vec_col: str = "embedding", count: int = COMPONENTS,
           carry: list[str] | None = None) -> tuple[DataFrame, dict]:
    """Rows that count with their columns (or those in ``carry``), ``whitened``
    (one double for each component) and ``deviation``; and what holds for all:
    n, explained (by component), identity_error."""
    carry = [c for c in (df.columns if carry is None else carry) if c not in OWN]
    rows, d = entries(df, vec_col, df.select(*[col(c) for c in carry]))
    fit = Whitener(df.sparkSession, rows, d, count)
    facts = {"n": fit.n, "explained": fit.explained,
             "identity_error": fit.identity_error(rows) if fit.explained else 0.0}
    if not fit.n:
        out = rows.select("_row", F.array().cast("array<double>").alias("whitened"),
                          F.lit(None).cast("decimal(38,0)").alias("deviation"))
    else:
        out = fit.apply(rows)
    return out.select(*unpacked(carry), "whitened", "deviation"), facts


def q_whitening(vectors: DataFrame) -> DataFrame:
    out, facts = whiten(vectors.select("vec_id", "embedding"), carry=["vec_id"])
    explained = F.array(*map(F.lit, facts["explained"])).cast("array<double>")
    return out.select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened")).select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(facts["n"]).cast("long").alias("n"),
        F.col("deviation").cast("long").alias("deviation"), "whitened", F.get(explained, F.col("_at")).alias("explained"),
        F.lit(facts["identity_error"]).cast("double").alias("identity_error"))
