"""Whitening of vectors by the exact characteristic polynomial of their integer scatter.

Components become whole numbers x = floor(64 c) + 1000000.  Tasks add up counts, sums, and then products of x centred on
the whole number next to each mean; all of it exactly.  n times the scatter of n rows, less the products of what the centre
leaves over, is n**2 times their covariance, a matrix of whole numbers.  Its characteristic polynomial is found modulo
primes (reduction to Hessenberg form, one prime a row of a Spark job) and put together by Chinese remaindering.  All its
roots are real, so Descartes' rule of signs counts the roots beyond any point exactly; bisection isolates each root and
narrows it to 200 bits.  A component is the null vector of matrix - root, by inverse iteration in 110 digits; roots that
agree in 100 bits share an orthonormal basis of their null space.  Every component is a row of a job as well.

What reaches the driver are sums over all rows, in as many numbers as a vector has components squared.

Cases: vectors that are null, empty or hold null or non-finite components are dropped; zero vectors and repeated rows count;
vectors of different widths are lists of their own; |64 c| beyond 2**61 is held there; components without variance (fewer
rows than dimensions, constant columns) are left out, so one row alone or equal rows give no result; a deviation that a
long cannot hold is null there and stands in ``deviation_exact`` up to 38 digits; null ids are kept; an empty table gives an
empty table; columns besides id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.frames import need
from basketry.session import written

COMPONENTS = 32
STEPS = 64
OFFSET = 1_000_000
#: bits of a root, bits in which equal roots agree, digits of inverse iteration
ROOT_BITS = 200
SAME_BITS = 100
DIGITS = 110
#: tasks' sums that one task adds up first
PARTS = 64
_LARGEST = float(1 << 61)
_LIMB = 20


# --- exact sums over all rows


def usable(vector: str) -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite, F.lit(False))


def by_width(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch of (id, vector) with equal widths, and their whole numbers without the offset, which no
    difference keeps.
    """
    widths = np.diff(batch.column(1).offsets.to_numpy())
    for width in np.unique(widths):
        part = batch.filter(pa.array(widths == width))
        flat = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(over="ignore"):
            steps = np.clip(np.floor(STEPS * flat), -_LARGEST, _LARGEST)
        yield part, steps.astype(np.int64).reshape(len(part), int(width))


def column_sums(x: np.ndarray) -> np.ndarray:
    """Exact sums of the columns, as Python's whole numbers."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return high.astype(object) * (1 << 32) + low.astype(object)


def gram(x: np.ndarray) -> np.ndarray:
    """Exact products of the columns with each other, as Python's whole numbers.

    Numbers are cut into limbs of 20 bits if they are longer; a product of floats then adds up so few rows at a time that
    every sum is a whole number below 2**53.
    """
    most = int(np.abs(x).max(initial=0))
    limbs, shift = [], 0
    if most < 1 << _LIMB:
        limbs.append((x.astype(np.float64), 0))
    else:
        sign, rest = np.sign(x), np.abs(x)
        while rest.any():
            limbs.append(((sign * (rest & ((1 << _LIMB) - 1))).astype(np.float64), shift))
            rest, shift = rest >> _LIMB, shift + _LIMB
        most = (1 << _LIMB) - 1
    rows = (1 << 53) // max(1, most * most)
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), rows):
        for a, p in limbs:
            for b, q in limbs:
                out += (a[at : at + rows].T @ b[at : at + rows]).astype(np.int64).astype(object) * (1 << (p + q))
    return out


def _row(width: int, n: int, sums: np.ndarray) -> dict:
    return {"width": width, "n": n, "sums": [str(v) for v in sums.ravel()]}


_SUMS = "width int, n long, sums array<string>"
_SUMS_SCHEMA = pa.schema([("width", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])


def _added(group: pa.Table) -> pa.Table:
    total, n = 0, 0
    for count, sums in zip(group["n"].to_pylist(), group["sums"].to_pylist(), strict=True):
        total, n = total + np.array([int(v) for v in sums], object), n + count
    return pa.Table.from_pylist([_row(group["width"][0].as_py(), n, total)], schema=_SUMS_SCHEMA)


def _totals(rows: DataFrame, measure) -> dict[int, tuple[int, np.ndarray]]:
    """Exact sums of ``measure(whole numbers)`` over all rows of each width."""

    def run(batches):
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in by_width(batch):
                n, sums = held.get(x.shape[1], (0, 0))
                held[x.shape[1]] = (n + len(x), sums + measure(x))
        if held:
            rows = [_row(w, n, sums) for w, (n, sums) in held.items()]
            yield pa.RecordBatch.from_pylist(rows, schema=_SUMS_SCHEMA)

    parts = rows.mapInArrow(run, _SUMS).withColumn("part", F.spark_partition_id() % PARTS)
    some = parts.groupBy("width", "part").applyInArrow(lambda g: _added(g), _SUMS)
    every = some.groupBy("width").applyInArrow(lambda g: _added(g), _SUMS).collect()
    return {r["width"]: (r["n"], np.array([int(v) for v in r["sums"]], object)) for r in every}


@dataclass
class Scatter:
    """What is known of the vectors of one width: n, whole centres, sums of the centred numbers, and n**2 times their
    covariance.
    """

    n: int
    centre: np.ndarray
    left: np.ndarray
    matrix: np.ndarray


def scatters(rows: DataFrame) -> dict[int, Scatter]:
    """Exact scatter of every width, in two passes."""
    means = {w: (n, np.array([(2 * s + n) // (2 * n) for s in sums], object), sums) for w, (n, sums) in _totals(rows, column_sums).items()}
    centres = {w: c.astype(np.int64) for w, (_, c, _) in means.items()}
    products = _totals(rows, lambda x: gram(x - centres[x.shape[1]]))
    out = {}
    for w, (n, centre, sums) in means.items():
        left = sums - n * centre
        out[w] = Scatter(n, centres[w], left, n * products[w][1].reshape(w, w) - np.outer(left, left))
    return out


# --- the characteristic polynomial


def primes_below(limit: int, bits: int) -> list[int]:
    """The greatest odd primes below a limit of at most 2**31, as many as it takes for a product of more than ``bits``."""
    out, product, at = [], 1, limit - 1 | 1
    while product.bit_length() <= bits:
        at -= 2
        # these four bases decide for all numbers below 3,215,031,751
        if all(_passes(at, base) for base in (2, 3, 5, 7)):
            out.append(at)
            product *= at
    return out


def _passes(n: int, base: int) -> bool:
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    x = pow(base, odd, n)
    if x in (1, n - 1):
        return True
    for _ in range(twos - 1):
        x = x * x % n
        if x == n - 1:
            return True
    return False


def polynomial_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo a prime below 2**31, that of the greatest power first."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        held = np.flatnonzero(h[k + 1 :, k])
        if not len(held):
            continue
        pivot = k + 1 + held[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        # rows lose multiples of the pivot's row, and the pivot's column gains the same of theirs
        times = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - times[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * times % p).sum(axis=1)) % p
    # polynomials of the leading blocks, lowest power first
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        polys[m, 1:] = polys[m - 1, :-1]
        weights = np.zeros(m, np.int64)
        run = 1
        for i in range(m - 1, -1, -1):
            weights[i] = run * int(h[i, m - 1]) % p
            if i:
                run = run * int(h[i, i - 1]) % p
        polys[m] = (polys[m] - (weights[:, None] * polys[:m] % p).sum(axis=0)) % p
    return polys[d, ::-1]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """e_0..e_d with det(x - matrix) = sum of (-1)**k e_k x**(d - k), exactly; no root is negative.

    The e_k are then not negative, and by Maclaurin's inequality at most those of d equal roots with the same sum.
    """
    d, trace = len(matrix), int(sum(matrix.diagonal()))
    bits = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1)).bit_length()
    *primes, check = primes_below(1 << 31, bits + 32)
    rows = spark.createDataFrame([(p,) for p in [*primes, check]], "p long")
    slots = min(len(primes) + 1, 4 * spark.sparkContext.defaultParallelism)

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                found = [str(v) for v in polynomial_modulo(matrix, p).tolist()]
                yield pa.RecordBatch.from_pylist([{"p": p, "found": found}], schema=pa.schema([("p", pa.int64()), ("found", pa.list_(pa.string()))]))

    found = {r["p"]: [int(v) for v in r["found"]] for r in rows.repartition(slots).mapInArrow(run, "p long, found array<string>").collect()}
    product = 1
    for p in primes:
        product *= p
    parts = [(p, product // p) for p in primes]
    units = [(p, rest * pow(rest, -1, p)) for p, rest in parts]
    out = [(-1) ** k * sum(found[p][k] * unit for p, unit in units) % product for k in range(d + 1)]
    if any(((-1) ** k * e - f) % check for k, (e, f) in enumerate(zip(out, found[check], strict=True))):
        raise ArithmeticError("the coefficients disagree with one more prime")
    return out


# --- roots and components


class Roots:
    """The roots of a polynomial that are all real and not negative, in falling order, with their multiplicity."""

    def __init__(self, e: list[int]):
        d = len(e) - 1
        #: the last power with a coefficient: the other roots are zero
        self.rank = max(k for k in range(d + 1) if e[k])
        self.coefficients = [(-1) ** k * e[k] for k in range(self.rank + 1)]
        self.top = e[1] + 1 if self.rank else 1
        self.beyond = lru_cache(maxsize=None)(self._beyond)

    def _beyond(self, a: int, bits: int) -> int:
        """How many roots are greater than a / 2**bits: sign changes of the polynomial moved there."""
        c = [v << (bits * k) for k, v in enumerate(self.coefficients)]
        if a:
            for end in range(len(c), 1, -1):
                for k in range(1, end):
                    c[k] += a * c[k - 1]
        signs = [v > 0 for v in c if v]
        return sum(x != y for x, y in zip(signs, signs[1:], strict=False))

    def _sign(self, a: int, bits: int) -> int:
        value = 0
        for k, v in enumerate(self.coefficients):
            value = value * a + (v << (bits * k))
        return (value > 0) - (value < 0)

    def root(self, k: int, precision: int = ROOT_BITS) -> tuple[int, int]:
        """(a, bits) with the k-th root, from 1, in ((a - 1) / 2**bits, a / 2**bits], to so many significant bits."""
        low, high, bits = 0, 1 << self.top.bit_length(), 0
        alone = False
        while True:
            while high - low > 1:
                if alone:
                    # the polynomial changes its sign at the only root between
                    middle = (low + high) // 2
                    sign = self._sign(middle, bits)
                    above = sign == 0 or sign == sign_high
                    low, high = (low, middle) if above else (middle, high)
                    continue
                middle = (low + high) // 2
                if self.beyond(middle, bits) >= k:
                    low = middle
                else:
                    high = middle
                alone = self.beyond(low, bits) - self.beyond(high, bits) == 1
                if alone:
                    # a sign at the upper end or, where that is a root, just beyond it
                    sign_high = self._sign(high, bits)
                    alone = sign_high != 0
            if low.bit_length() >= precision:
                return high, bits
            more = max(16, precision - high.bit_length() + 1) if alone else 16
            low, high, bits = low << more, high << more, bits + more

    def group(self, k: int) -> tuple[int, int]:
        """First and last number of the roots that agree with the k-th in SAME_BITS bits."""
        a, bits = self.root(k)
        slack = a >> SAME_BITS
        return self.beyond(a + slack, bits) + 1, self.beyond(max(a - 1 - slack, 0), bits)


def null_vectors(matrix: np.ndarray, root: Decimal, many: int) -> list[np.ndarray]:
    """Orthonormal vectors that matrix - root takes to nothing, by inverse iteration; call in a context of DIGITS digits."""
    d = len(matrix)
    a = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
    a[np.arange(d), np.arange(d)] -= root
    least = max(abs(a).max(), Decimal(1)).scaleb(-DIGITS)
    draw = np.random.default_rng(d)
    b = np.array([[Decimal(int(v)) for v in row] for row in draw.integers(1, 1 << 30, (d, many))], object)
    for k in range(d):
        pivot = k + int(np.argmax(abs(a[k:, k])))
        if pivot != k:
            a[[k, pivot]], b[[k, pivot]] = a[[pivot, k]], b[[pivot, k]]
        if abs(a[k, k]) < least:
            a[k, k] = least
        if k + 1 < d:
            times = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(times, a[k, k + 1 :])
            b[k + 1 :] -= np.outer(times, b[k])
    out: list[np.ndarray] = []
    x = np.zeros((d, many), object)
    for k in range(d - 1, -1, -1):
        x[k] = (b[k] - a[k, k + 1 :] @ x[k + 1 :] if k + 1 < d else b[k]) / a[k, k]
    for c in range(many):
        v = x[:, c] / max(abs(x[:, c]))
        for _ in range(2):
            for other in out:
                v = v - other * (other @ v)
        v = v / (v @ v).sqrt()
        # either sign would do; the greatest entry is positive
        out.append(v if v[int(np.argmax(abs(v)))] > 0 else -v)
    return out


@dataclass
class Components:
    """Per component a unit vector (a column each), the root of its eigenvalue, and its share of the whole variance."""

    vectors: np.ndarray
    scale: np.ndarray
    explained: np.ndarray


def components(spark: SparkSession, known: Scatter, most: int = COMPONENTS) -> Components:
    """Up to ``most`` components with variance, those of greatest variance first."""
    d = len(known.matrix)
    if not any(known.matrix.diagonal()):
        return Components(np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    e = characteristic_polynomial(spark, known.matrix)
    rank = Roots(e).rank
    matrix, n, trace = known.matrix, known.n, int(sum(known.matrix.diagonal()))
    schema = pa.schema([("k", pa.int32()), ("scale", pa.float64()), ("explained", pa.float64()), ("vector", pa.list_(pa.float64()))])

    def run(batches):
        roots = Roots(e)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                first, last = roots.group(k)
                with localcontext() as context:
                    context.prec = DIGITS
                    # of equal roots the first decides; a little beyond, so that no matrix is singular
                    a, bits = roots.root(first)
                    vectors = null_vectors(matrix, Decimal(a + 1) / Decimal(1 << bits), last - first + 1)
                    a, bits = roots.root(k)
                    root = Decimal(a) / Decimal(1 << bits)
                    row = {
                        "k": k,
                        "scale": float(root.sqrt() / n),
                        "explained": float(root / trace),
                        "vector": [float(v) for v in vectors[k - first]],
                    }
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    wanted = min(most, rank)
    numbers = spark.createDataFrame([(k,) for k in range(1, wanted + 1)], "k int").repartition(wanted)
    found = numbers.mapInArrow(run, "k int, scale double, explained double, vector array<double>").collect()
    found.sort(key=lambda r: r["k"])
    return Components(
        np.array([r["vector"] for r in found]).T, np.array([r["scale"] for r in found]), np.array([r["explained"] for r in found])
    )


# --- whitened rows


def whitened(x: np.ndarray, known: Scatter, parts: Components) -> np.ndarray:
    """Rows less the mean, on the components, over the roots of the eigenvalues."""
    mean = np.array([float(Decimal(int(v)) / known.n) for v in known.left])
    return ((x - known.centre).astype(np.float64) - mean) @ (parts.vectors / parts.scale)


def deviations(x: np.ndarray, known: Scatter) -> np.ndarray:
    """Exact sums of (n x - S)**2 as Python's whole numbers."""
    z = x - known.centre
    most = max(int(np.abs(z).max(initial=0)), 1)
    if most * max(most, *(abs(int(v)) for v in known.left)) * z.shape[1] < 1 << 62:
        squares, mixed = (z * z).sum(axis=1).astype(object), (z @ known.left.astype(np.int64)).astype(object)
    else:
        z = z.astype(object)
        squares, mixed = (z * z).sum(axis=1), z @ known.left
    n = known.n
    return n * n * squares - 2 * n * mixed + int((known.left * known.left).sum())


def _merged_covariance(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, centred products) of all parts together."""
    n, mean, products = rows[0]
    for m, other, more in rows[1:]:
        apart = other - mean
        products = products + more + np.outer(apart, apart) * (n * m / (n + m))
        mean, n = mean + apart * (m / (n + m)), n + m
    return n, mean, products


def identity_errors(rows: DataFrame, known: dict[int, Scatter], parts: dict[int, Components]) -> dict[int, float]:
    """Greatest absolute entry of the whitened rows' covariance, less the identity."""
    schema = pa.schema([("width", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])
    ddl = "width int, n long, mean array<double>, products array<double>"

    def row(width: int, n: int, mean: np.ndarray, products: np.ndarray) -> pa.RecordBatch:
        found = {"width": width, "n": n, "mean": mean.tolist(), "products": products.ravel().tolist()}
        return pa.RecordBatch.from_pylist([found], schema=schema)

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for _, x in by_width(batch):
                width = x.shape[1]
                w = whitened(x, known[width], parts[width])
                mean = w.mean(axis=0)
                own = (len(w), mean, (w - mean).T @ (w - mean))
                held[width] = _merged_covariance([held[width], own]) if width in held else own
        for width, own in held.items():
            yield row(width, *own)

    def add(group: pa.Table) -> pa.Table:
        own = []
        for n, mean, products in zip(group["n"].to_pylist(), group["mean"].to_pylist(), group["products"].to_pylist(), strict=True):
            own.append((n, np.array(mean), np.array(products).reshape(len(mean), len(mean))))
        return pa.Table.from_batches([row(group["width"][0].as_py(), *_merged_covariance(own))])

    some = rows.mapInArrow(run, ddl).withColumn("part", F.spark_partition_id() % PARTS)
    some = some.groupBy("width", "part").applyInArrow(lambda g: add(g), ddl)
    out = {}
    for r in some.groupBy("width").applyInArrow(lambda g: add(g), ddl).collect():
        size = len(r["mean"])
        covariance = np.array(r["products"]).reshape(size, size) / r["n"]
        out[r["width"]] = float(np.abs(covariance - np.eye(size)).max(initial=0.0))
    return out


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error and
    deviation_exact.
    """
    need(vectors, vec_id=vec_id, vector=vector)
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector")).where(usable("vector"))
    rows = written(rows, "vectors")
    only = rows.select("vec_id", "vector")
    known = scatters(only)
    parts = {w: components(rows.sparkSession, s, most) for w, s in known.items()}
    errors = identity_errors(only, known, parts)
    kind = rows.schema["vec_id"].dataType.simpleString()
    ddl = (
        f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double, deviation_exact decimal(38,0)"
    )

    def run(batches):
        for batch in batches:
            for part, x in by_width(batch):
                width = x.shape[1]
                own, scatter = parts[width], known[width]
                size = len(own.scale)
                if not size:
                    continue
                w, exact = whitened(x, scatter, own), deviations(x, scatter).tolist()
                each = np.repeat(np.arange(len(x)), size)
                take = pa.array(each)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(each), scatter.n, np.int64)),
                        pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()).take(take),
                        pa.array(w.ravel()),
                        pa.array(np.tile(own.explained, len(x))),
                        pa.array(np.full(len(each), errors[width])),
                        pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)).take(take),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"],
                )

    return only.mapInArrow(run, ddl)
