"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become whole numbers, so the scatter ``A = n * sum(x x') - S S'`` (n squared times the covariance) is an integer
matrix that tasks sum without rounding. Its characteristic polynomial is found modulo many primes, each by a similarity
transform to Hessenberg form in a task of its own, and put together by Chinese remainders; a bound on its coefficients says
how many primes are enough, and two more check the outcome. ``A`` is symmetric, so all roots are real and Descartes' rule
counts those above a point exactly, multiples included: bisection isolates each root, and the polynomial's sign refines it
far below double precision. A component is the null space of ``A - root``, by inverse iteration with decimals of the
digits that root and matrix have; a multiple root gives as many vectors at right angles.

The work on the matrix is some d**4 steps for d dimensions and does not depend on the number of rows but for the length
of its numbers. What comes to the driver is d * d / 2 sums, the polynomial, and the components.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, staged
from .topk import _matrix

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Bits below one to which roots are found at first, and bits that each must have in all.
POINT, ROOT_BITS = 80, 64
#: Rows and bits of a product's factors for which sums of products are exact in double precision.
BLOCK, FACTOR_BITS = 1 << 11, 21
#: Largest magnitude of an entry that is taken.
MOST_ENTRY = 2.0**55
LIMB = 60
STEPS = 4


def whole(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, y): floor(scale * c) of each entry c, as double. Vectors that are null or empty, or hold null, non-finite or huge entries, go."""
    c = F.col(embedding).cast("array<double>")
    fit = F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST_ENTRY)), F.lit(False))
    return vectors.where(fit).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(c, lambda x: F.floor(x * scale)).alias("y"))


# ---- the scatter ------------------------------------------------------------------------------------------------------


def products(y: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of columns, exact: a matrix of Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK):
        block = y[at : at + BLOCK]
        limbs, rest = [], block
        while True:  # signed digits of base 2 ** FACTOR_BITS
            low = ((rest + (1 << FACTOR_BITS - 1)) & ((1 << FACTOR_BITS) - 1)) - (1 << FACTOR_BITS - 1)
            limbs.append(low.astype(float))
            rest = (rest - low) >> FACTOR_BITS
            if not rest.any():
                break
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << FACTOR_BITS * (i + j)
    return total


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each length: rows (-1, -1) the number of vectors, (-1, j) sums, (i, j) with i <= j sums of products, in limbs."""
    held: dict[int, list] = {}
    for batch in batches:
        for rows, y in _matrix(batch.column("y")) if batch.num_rows else []:
            n, s, p = held.get(y.shape[1], (0, 0, 0))
            held[y.shape[1]] = [n + len(rows), s + y.astype(object).sum(0), p + products(y)]
    for d, (n, s, p) in held.items():
        at = [(-1, -1, n), *((-1, j, int(s[j])) for j in range(d)), *((i, j, int(p[i, j])) for i in range(d) for j in range(i, d))]
        mask = (1 << LIMB) - 1
        columns = [[d] * len(at), *zip(*((i, j, v & mask, v >> LIMB & mask, v >> 2 * LIMB) for i, j, v in at), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["d", "i", "j", "l0", "l1", "l2"])


def scatters(held: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By length: number of vectors, sums by dimension, and the scatter n * sum(y y') - S S'. Only sums come to the driver."""
    parts = held.mapInArrow(_partial_sums, "d long, i long, j long, l0 long, l1 long, l2 long")
    sums = parts.groupBy("d", "i", "j").agg(*(F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("l0", "l1", "l2")))
    found: dict[int, dict] = {}
    for r in sums.collect():
        found.setdefault(r.d, {})[r.i, r.j] = int(r.l0) + (int(r.l1) << LIMB) + (int(r.l2) << 2 * LIMB)
    out = {}
    for d, at in found.items():
        n, s = at[-1, -1], [at[-1, j] for j in range(d)]
        out[d] = n, s, [[n * at[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]
    return out


# ---- the characteristic polynomial ------------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """For odd n below 2**32."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 7, 61):
        x = pow(base, odd, n)
        if x in (0, 1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(product: int, more: int) -> list[int]:
    """The largest primes below 2**31, of a product above ``product``, and ``more`` of them besides."""
    out, at = [], 2**31 - 1
    while product > 0 or more > 0:
        if is_prime(at):
            out.append(at)
            product, more = (product // at, more) if product > 0 else (0, more - 1)
        at -= 2
    return out


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo the prime ``p`` with nothing below the first subdiagonal."""
    h = a % p
    for m in range(len(h) - 2):
        there = np.flatnonzero(h[m + 1 :, m])
        if not len(there):
            continue
        if there[0]:
            k = m + 1 + there[0]
            h[[m + 1, k]] = h[[k, m + 1]]
            h[:, [m + 1, k]] = h[:, [k, m + 1]]
        u = h[m + 2 :, m] * pow(int(h[m + 1, m]), -1, p) % p
        h[m + 2 :] = (h[m + 2 :] - u[:, None] * h[m + 1]) % p
        h[:, m + 1] = (h[:, m + 1] + (h[:, m + 2 :] * u % p).sum(1)) % p
    return h


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """det(x - a) modulo ``p``, coefficients from the constant up: leading minors of the Hessenberg form, one by one."""
    h, d = hessenberg(a, p), len(a)
    minors = np.zeros((d + 1, d + 1), np.int64)
    minors[0, 0] = 1
    for k in range(d):
        factor, below = np.zeros(k + 1, np.int64), 1
        factor[k] = h[k, k]
        for j in range(k - 1, -1, -1):
            below = below * int(h[j + 1, j]) % p
            factor[j] = int(h[j, k]) * below % p
        minors[k + 1] = (np.roll(minors[k], 1) - (factor[:, None] * minors[: k + 1] % p).sum(0)) % p
    return minors[d]


def most_coefficient(trace: int, d: int) -> int:
    """No elementary symmetric function of d numbers >= 0 of this sum is larger (Maclaurin)."""
    return max(math.comb(d, k) * trace**k // d**k for k in range(d + 1)) + 1


def remaindered(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """The numbers from 0 below the product of ``moduli`` that have these residues, a list for each modulus."""
    product = math.prod(moduli)
    parts = [product // p * pow(product // p, -1, p) for p in moduli]
    return [sum(r * part for r, part in zip(column, parts, strict=True)) % product for column in zip(*residues, strict=True)]


def polynomials(spark: SparkSession, matrices: dict[int, list[list[int]]]) -> dict[int, list[int]]:
    """det(x - A) of symmetric matrices without negative eigenvalues, by length, coefficients from the leading one down."""
    tasks, checks = [], {}
    for d, a in matrices.items():
        taken = primes(most_coefficient(sum(a[k][k] for k in range(d)), d), 2)
        tasks += [(d, p) for p in taken]
        checks[d] = taken
    if not tasks:
        return {}
    shared = spark.sparkContext.broadcast({d: np.array(a, object).reshape(d, d) for d, a in matrices.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, p = batch.column("d").to_pylist(), batch.column("p").to_pylist()
            found = [polynomial_mod((shared.value[i] % m).astype(np.int64), m).tolist() for i, m in zip(d, p, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("p"), pa.array(found, pa.list_(pa.int64()))], ["d", "p", "c"])

    todo = spark.createDataFrame(tasks, "d long, p long").repartition(min(len(tasks), spark.sparkContext.defaultParallelism))
    by = {(r.d, r.p): r.c for r in todo.mapInArrow(run, "d long, p long, c array<long>").collect()}
    out = {}
    for d, taken in checks.items():
        # Signs alternate, so the numbers sought are from 0 up.
        residues = [[c if (d - k) % 2 == 0 else -c % p for k, c in enumerate(by[d, p])] for p in taken]
        found = remaindered(residues[:-2], taken[:-2])
        if any(c % p != r for p, row in zip(taken[-2:], residues[-2:], strict=True) for c, r in zip(found, row, strict=True)):
            raise ArithmeticError("a check prime disagrees with the characteristic polynomial")
        out[d] = [c if (d - k) % 2 == 0 else -c for k, c in enumerate(found)][::-1]
    return out


# ---- roots ------------------------------------------------------------------------------------------------------------


class Roots:
    """Positive roots of a monic integer polynomial all of whose roots are real, at ``point`` binary places."""

    def __init__(self, coefficients: list[int], point: int):
        self.c = [a << point * k for k, a in enumerate(coefficients)]  # of the roots times 2 ** point

    def above(self, at: int) -> int:
        """Number of roots above ``at``: changes of sign in the polynomial moved there, by Descartes' rule."""
        moved = self.c[:]
        for end in range(len(moved) - 1, 0, -1):
            for k in range(1, end + 1):
                moved[k] += at * moved[k - 1]
        signs = [c > 0 for c in moved if c]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))

    def odd_above(self, at: int) -> bool:
        """Whether an odd number of roots lies above ``at``; where it is a root itself, of those from ``at`` on, less one."""
        value = 0
        for c in self.c:
            value = value * at + c
        return value < 0

    def largest(self, most: int, bound: int) -> list[tuple[int, int]]:
        """(root, multiplicity) from the largest of at least ``most`` roots, or of all; a root is within (root - 1, root]."""
        out, taken = [], 0
        todo = [(0, bound, self.above(0), 0)]
        while todo and taken < most:
            low, high, more, less = todo.pop()
            if more == less:
                continue
            if high - low == 1:
                out.append((high, more - less))
                taken += more - less
            elif more - less == 1:
                while high - low > 1:
                    middle = (low + high) // 2
                    low, high = (middle, high) if self.odd_above(middle) == bool(more % 2) and not self.is_root(middle) else (low, middle)
                out.append((high, 1))
                taken += 1
            else:
                middle = (low + high) // 2
                split = self.above(middle)
                todo += [(low, middle, more, split), (middle, high, split, less)]
        return out

    def is_root(self, at: int) -> bool:
        value = 0
        for c in self.c:
            value = value * at + c
        return value == 0


def largest_roots(coefficients: list[int], trace: int, most: int = COMPONENTS) -> tuple[list[tuple[int, int]], int]:
    """The ``most`` largest positive roots as (root, multiplicity) and the binary places, so many that each has ``ROOT_BITS``."""
    point = POINT
    while True:
        found = Roots(coefficients, point).largest(most, trace << point)
        if not found or found[-1][0].bit_length() >= ROOT_BITS:
            return found, point
        point *= 2


# ---- components -------------------------------------------------------------------------------------------------------


def null_space(a: np.ndarray, root: int, point: int, size: int) -> np.ndarray:
    """``size`` unit vectors at right angles to which ``a - root / 2**point`` does next to nothing: inverse iteration."""
    digits = max(len(str(v)) for v in [*map(abs, a.ravel().tolist()), root]) + point // 3 + 30
    with decimal.localcontext(prec=digits, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN):
        d = len(a)
        m = np.array([[Decimal(v) for v in row] for row in a.tolist()], object).reshape(d, d)
        m[np.arange(d), np.arange(d)] -= Decimal(root) / (1 << point)
        order = np.arange(d)
        for k in range(d):
            best = k + int(np.argmax(np.abs(m[k:, k])))
            if best != k:
                m[[k, best]], order[[k, best]] = m[[best, k]], order[[best, k]]
            if not m[k, k]:
                m[k, k] = Decimal(10) ** -digits
            m[k + 1 :, k] = m[k + 1 :, k] / m[k, k]
            m[k + 1 :, k + 1 :] -= m[k + 1 :, k, None] * m[k, k + 1 :]
        # No two starts are alike, and none is at right angles to a component but by chance of all its digits.
        x = np.array([[Decimal(pow(3 + 2 * c, 7 + i, 2**31 - 1)) for c in range(size)] for i in range(d)], object)
        for _ in range(STEPS):
            x = x[order]
            for k in range(d):
                x[k + 1 :] -= m[k + 1 :, k, None] * x[k]
            for k in range(d - 1, -1, -1):
                x[k] = x[k] / m[k, k]
                x[:k] -= m[:k, k, None] * x[k]
            for c in range(size):
                for _ in range(2):
                    for b in range(c):
                        x[:, c] -= x[:, b] * (x[:, b] * x[:, c]).sum()
                    x[:, c] = x[:, c] / (x[:, c] * x[:, c]).sum().sqrt()
        out = x.T.astype(float)
    return out * np.sign(out[np.arange(size), np.abs(out).argmax(1)])[:, None]


def components(spark: SparkSession, matrices: dict[int, list[list[int]]], roots: dict[int, tuple[list[tuple[int, int]], int]], most: int) -> dict[int, np.ndarray]:
    """By length, a matrix whose rows are the components, a task for each root."""
    tasks = [(d, k, str(root), point, size) for d, (found, point) in roots.items() for k, (root, size) in enumerate(found)]
    if not tasks:
        return {}
    shared = spark.sparkContext.broadcast({d: np.array(a, object).reshape(d, d) for d, a in matrices.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [null_space(shared.value[r["d"]], int(r["root"]), r["point"], r["size"]).tolist() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("k"), pa.array(found, pa.list_(pa.list_(pa.float64())))], ["d", "k", "u"])

    todo = spark.createDataFrame(tasks, "d long, k long, root string, point long, size long").repartition(min(len(tasks), spark.sparkContext.defaultParallelism))
    by = {(r.d, r.k): r.u for r in todo.mapInArrow(run, "d long, k long, u array<array<double>>").collect()}
    return {d: np.array([u for k in range(len(found)) for u in by[d, k]][:most]) for d, (found, _) in roots.items() if found}


# ---- the operator -----------------------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What a fit found for vectors of one length."""

    n: int
    sums: list[int]
    trace: int
    roots: list[float]  # eigenvalues of the scatter, falling
    vectors: np.ndarray  # components, a row each
    identity_error: float = math.nan

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n * y - S, exact: 64-bit numbers where they fit, else Python's."""
        small = int(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.sums)) < 2**62
        return (y if small else y.astype(object)) * self.n - np.array(self.sums, np.int64 if small else object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        """The square root of the scatter's eigenvalue is n times that of the covariance's, as a deviation is n times that of x."""
        return deviations.astype(float) @ (self.vectors / np.sqrt(self.roots)[:, None]).T


def _squared(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None beyond 64 bits."""
    if deviations.dtype != object and int(np.abs(deviations).max(initial=0)) ** 2 * deviations.shape[1] < 2**63:
        return (deviations * deviations).sum(1).tolist()
    found = [sum(int(v) * int(v) for v in row) for row in deviations]
    return [v if v < 2**63 else None for v in found]


def fit(held: DataFrame, most: int = COMPONENTS) -> dict[int, Whitening]:
    """Whitenings by length of the vectors ``y`` in ``held``."""
    spark = held.sparkSession
    found = {d: x for d, x in scatters(held).items() if any(x[2][k][k] for k in range(d))}
    matrices = {d: a for d, (_, _, a) in found.items()}
    trace = {d: sum(a[k][k] for k in range(d)) for d, a in matrices.items()}
    roots = {d: largest_roots(c, trace[d], most) for d, c in polynomials(spark, matrices).items()}
    vectors = components(spark, matrices, roots, most)
    out = {}
    for d, (n, s, _) in found.items():
        values = [float(Decimal(r) / (1 << roots[d][1])) for r, size in roots[d][0] for _ in range(size)][:most]
        out[d] = Whitening(n, s, trace[d], values, vectors[d])
    return out


def measure(held: DataFrame, fits: dict[int, Whitening]) -> None:
    """Set each fit's identity_error: how far the covariance of the whitened rows is from the identity."""
    shared = held.sparkSession.sparkContext.broadcast({d: asdict(f) for d, f in fits.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, y in _matrix(batch.column("y")) if batch.num_rows else []:
                if y.shape[1] in shared.value:
                    f = Whitening(**shared.value[y.shape[1]])
                    w = f.whitened(f.deviations(y))  # deviations from the exact mean: centred
                    s, p = sums.get(y.shape[1], (0, 0))
                    sums[y.shape[1]] = [s + w.sum(0), p + w.T @ w]
        for d, (s, p) in sums.items():
            k = len(s)
            at = [*((-1, j, s[j]) for j in range(k)), *((i, j, p[i, j]) for i in range(k) for j in range(k))]
            columns = [[d] * len(at), *zip(*at, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["d", "i", "j", "s"])

    by = held.mapInArrow(run, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect()
    at = {(r.d, r.i, r.j): r.s for r in by}
    for d, f in fits.items():
        k = range(len(f.roots))
        mean = [at[d, -1, j] / f.n for j in k]
        f.identity_error = max(abs(at[d, i, j] / f.n - mean[i] * mean[j] - (i == j)) for i in k for j in k)


def whiten(vectors: DataFrame, most: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component.

    Vectors that are null or empty, or hold null, non-finite or (from 2**55) huge entries, take no part. Vectors are fitted
    with those of equal length. Components whose variance is zero have no whitened value and are left out, so equal vectors,
    a single one, or an empty table give no rows. Components of one eigenvalue are any at right angles. Rows repeated in
    vec_id count and return each; a null vec_id stays. A deviation beyond 64 bits is null. Columns other than vec_id and
    embedding are not looked at. Rows are read three times from the shared folder: for sums, for the error, for the result.
    """
    held = staged(whole(spread(vectors), scale=scale), "whole")
    fits = fit(held, most)
    measure(held, fits)
    shared = held.sparkSession.sparkContext.broadcast({d: asdict(f) for d, f in fits.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, y in _matrix(batch.column("y")) if batch.num_rows else []:
                if y.shape[1] not in shared.value:
                    continue
                f, n = Whitening(**shared.value[y.shape[1]]), len(rows)
                deviations = f.deviations(y)
                explained = [float(r / f.trace) for r in f.roots]
                columns = [
                    batch.column("vec_id").take(pa.array(rows)),
                    pa.array([f.n] * n, pa.int64()),
                    pa.array(_squared(deviations), pa.int64()),
                    pa.array(list(f.whitened(deviations)), pa.list_(pa.float64())),
                    pa.array([explained] * n, pa.list_(pa.float64())),
                    pa.array([f.identity_error] * n, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "n", "deviation", "w", "e", "identity_error"])

    rows = held.mapInArrow(run, "vec_id long, n long, deviation long, w array<double>, e array<double>, identity_error double")
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("w", "e")).alias("at", "of"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("of.w").alias("whitened"), F.col("of.e").alias("explained"), "identity_error")
