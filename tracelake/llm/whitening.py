"""Embedding whitening: exact sums, a compensated covariance merged across tasks, principal components, whitened rows.

Entries become integers x = floor(1024 * c) + 100000, so their sums are exact. The
covariance is centred before it is multiplied: x less the mean is a pair of doubles
(high and low), found by error-free transformations. A block of rows is cut into
slices of SLICE_BITS bits; products of two slices are sums of integers below 2^53,
which a matrix product gives without any rounding, and these exact products are added
to a task's matrix in double-double. Tasks return high and low parts of their rows of
the matrix, and these are merged, again in double-double, 64 tasks at a time, until
one is left. So neither the number of rows, nor their order, nor a large mean costs
digits. The eigenvectors come from the matrix of the size of a vector squared: LAPACK's
symmetric solver, which reduces to tridiagonal form and solves that by divide and conquer.

Defined cases: rows whose vector is null, or has a null or non-finite entry or one of
2^42 or more, take no part, nor do rows of another length than the most frequent one
(of equal ones the longest). Components without variance are left out, so equal or
too few vectors give fewer, or none. Repeated rows and ids count each. An empty table
gives an empty result; deviations beyond a long are null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored

SCALE, SHIFT = 1024, 100_000
#: Rows of a block and bits of a slice: 2 * 20 + 10 bits are less than a double's 53.
BLOCK, SLICE_BITS, SLICES = 1024, 20, 4
MERGED = 64


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what rounding took."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add_pairs(hi: np.ndarray, lo: np.ndarray, more_hi: np.ndarray, more_lo: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-double numbers."""
    s, e = two_sum(hi, more_hi)
    t, f = two_sum(lo, more_lo)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


class Fit(NamedTuple):
    """Number of vectors, their sums, and the mean as a pair of doubles."""

    n: int
    sums: list[int]
    mean: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(n: int, sums: list[int]) -> Fit:
        exact = [Fraction(s, n) for s in sums]
        high = [float(m) for m in exact]
        return Fit(n, sums, (np.array(high), np.array([float(m - Fraction(h)) for m, h in zip(exact, high, strict=True)])))

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the mean, as pairs of doubles."""
        s, e = two_sum(x.astype(np.float64), -self.mean[0])
        return two_sum(s, e - self.mean[1])


def fixed_point(vectors: pa.Array) -> np.ndarray:
    """Vectors of equal length as integers."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(vectors), -1)


def outer_sums(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the outer products of at most BLOCK rows of pairs, as pairs: products of slices are exact."""
    dim = hi.shape[1]
    total, rest = np.zeros((dim, dim)), np.zeros((dim, dim))
    top = np.abs(hi).max(initial=0.0)
    if not top:
        return total, rest
    unit, slices = 2.0 ** (np.frexp(top)[1] - SLICE_BITS), []
    for _ in range(SLICES):
        whole = np.rint(hi / unit)
        slices.append((whole, unit))
        hi, lo = two_sum(hi - whole * unit, lo)
        unit *= 2.0**-SLICE_BITS
    for i in range(SLICES):
        for j in range(i, SLICES - i):
            exact = slices[i][0].T @ slices[j][0]
            # What is transposed may double the sum, still below 2^53.
            exact = exact if i == j else exact + exact.T
            total, rest = add_pairs(total, rest, exact * (slices[i][1] * slices[j][1]), 0.0)
    return total, rest


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    good = F.forall("vec", lambda c: F.coalesce(F.abs(c) < float(2**42), F.lit(False)))  # not for NaN, which is above all numbers
    rows = rows.where(F.col("vec").isNotNull() & good & (F.size("vec") > 0))
    length = rows.groupBy(F.size("vec").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return rows.where(F.size("vec") == (length[0]["length"] if length else 0))


def fit(rows: DataFrame) -> Fit | None:
    """Exact sums: one row for each task, one for each dimension at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x = fixed_point(batch.column(0).slice(at, BLOCK))
                more = x.sum(axis=0).astype(object)  # below 2^63, as entries are below 2^52 and rows at most 2^10
                n, sums = n + len(x), more if sums is None else sums + more
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([[str(s) for s in sums]])], names=["n", "sums"])

    parts = stored(rows.select("vec").mapInArrow(run, "n bigint, sums array<string>"), "sums")
    n = parts.agg(F.sum("n")).first()[0]
    sums = parts.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    return Fit.of(n, [int(r.s) for r in sums]) if n else None


def covariance(rows: DataFrame, fitted: Fit) -> np.ndarray:
    """The covariance, divisor n."""
    names = ["task", "k", "hi", "lo"]
    schema = "task bigint, k int, hi array<double>, lo array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi = lo = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                more = outer_sums(*fitted.centred(fixed_point(batch.column(0).slice(at, BLOCK))))
                hi, lo = more if hi is None else add_pairs(hi, lo, *more)
        if hi is not None:
            n = len(hi)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(list(hi)), pa.array(list(lo))], names=names)

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("task")
        hi = lo = None
        for a, b in zip(table.column("hi"), table.column("lo"), strict=True):
            more = a.values.to_numpy(), b.values.to_numpy()
            hi, lo = more if hi is None else add_pairs(hi, lo, *more)
        return pa.table([pa.array([table.column("task")[0].as_py() // MERGED]), table.column("k").slice(0, 1), pa.array([hi]), pa.array([lo])], names=names)

    parts = stored(rows.select("vec").mapInArrow(run, schema), "products")
    last = parts.agg(F.max("task")).first()[0]
    while last:  # a group holds the rows of 64 tasks at most
        parts, last = parts.groupBy("k", F.expr(f"task div {MERGED}")).applyInArrow(merge, schema), last // MERGED
    found = sorted(parts.select("k", "hi", "lo").collect())
    wide = np.array([r.hi for r in found], np.longdouble) + np.array([r.lo for r in found], np.longdouble)
    return (wide / fitted.n).astype(np.float64)


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns; the largest entry of each is positive."""
    values, vectors = np.linalg.eigh(cov)  # tridiagonal form, then divide and conquer
    values, vectors = values[::-1], vectors[:, ::-1]
    n = min(most, int((values > len(cov) * np.finfo(float).eps * max(values[0], 0.0)).sum()))
    values, vectors = values[:n], vectors[:, :n]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)]) if n else np.ones(0)
    return values, vectors * signs


def deviations(x: np.ndarray, fitted: Fit) -> list[int | None]:
    """Sum of (n * x - S)^2 of each row, exact."""
    most = max(abs(fitted.n * int(v) - s) for s, column in zip(fitted.sums, x.T, strict=True) for v in (column.min(), column.max()))
    kind = np.int64 if x.shape[1] * most**2 < 2**63 else object
    off = fitted.n * x.astype(kind) - np.array(fitted.sums, kind)
    return [int(v) if v < 2**63 else None for v in (off * off).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, *, most: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector that takes part and component."""
    rows = usable(vectors, id_col, vector_col)
    kind = dict(rows.dtypes)["id"]
    fitted = fit(rows)
    if fitted is None:
        return rows.sparkSession.createDataFrame([], f"id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    cov = covariance(rows, fitted)
    values, axes = components(cov, most)
    scaled = axes / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = fixed_point(part.column(1))
                hi, lo = fitted.centred(x)
                white = hi @ scaled + lo @ scaled
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations(x, fitted), pa.int64()), pa.array(list(white), pa.list_(pa.float64()))], names=["id", "deviation", "white"])

    done = stored(rows.mapInArrow(run, f"id {kind}, deviation bigint, white array<double>"), "white")
    k = len(values)
    entry = lambda i: F.element_at("white", i + 1)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = done.agg(F.count(F.lit(1)), *[F.sum(entry(i)) for i in range(k)], *[F.sum(entry(i) * entry(j)) for i, j in pairs]).first()
    error = max([abs(sums[1 + k + p] / fitted.n - sums[1 + i] * sums[1 + j] / fitted.n**2 - (i == j)) for p, (i, j) in enumerate(pairs)], default=0.0)
    explained = F.array(*[F.lit(float(e / np.trace(cov))) for e in values]) if k else F.array().cast("array<double>")
    out = done.select("id", "deviation", F.posexplode("white").alias("place", "whitened"))
    return out.select("id", (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("place")).alias("explained"), F.lit(float(error)).alias("identity_error"))
