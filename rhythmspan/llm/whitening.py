"""Whitening of embeddings by a compensated covariance.

Entries are read as whole numbers, so counts and sums are exact. Centred outer products are taken
in slices of so few bits that a matrix product of a block has no rounding error, and these are
added up in double-double (a high and a low part, by error-free sums) in each task; high and low
parts of the tasks are merged in tasks again. The driver gets a bounded number of D x D sums. The
eigenproblem is solved by reduction to tridiagonal form and divide and conquer (``syevd``, which
``numpy.linalg.eigh`` calls).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import partitions, staged

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Rows in a block, bits in a slice, slices of an entry: 2 * 20 + 10 bits of a block's sum fit into a double's 53.
BLOCK, BITS, SLICES = 1024, 21, 4
#: Entries from this size on have no exact place in the sums.
LARGEST = float(1 << 46)
#: Merged sums that reach the driver.
MERGED = 64


def scaled(embedding: str = "embedding") -> Column:
    """The vector in whole numbers; null if it is null or holds an entry that is null, not finite or beyond ``LARGEST``."""
    fit = F.forall(embedding, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return F.when(fit, F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT))


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b and what rounding lost, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


@dataclass
class DoubleDouble:
    """Sums of two parts, about 106 bits."""

    high: np.ndarray
    low: np.ndarray

    @classmethod
    def zeros(cls, *shape: int) -> DoubleDouble:
        return cls(np.zeros(shape), np.zeros(shape))

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        s, lost = two_sum(self.high, high)
        t, lost_low = two_sum(self.low, np.broadcast_to(low, s.shape))
        s, lost = two_sum(s, lost + t)
        self.high, self.low = two_sum(s, lost + lost_low)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Parts of ``high + low`` of ``BITS`` bits each, largest first, on one grid for each column."""
    top = np.abs(high).max(axis=0)
    exponent = np.where(top > 0, np.frexp(top)[1], 0).astype(np.float64)
    parts, rest = [], high
    for i in range(SLICES):
        grid = 1.5 * np.exp2(exponent - BITS * (i + 1) + 53)
        part = (rest + grid) - grid
        rest = rest - part
        if i == 1:
            rest, low = two_sum(rest, low)
        elif i > 1:
            rest, low = rest + low, 0.0
        parts.append(part)
    return parts


def outer_products(into: DoubleDouble, high: np.ndarray, low: np.ndarray) -> None:
    """Add the outer products of all rows of ``high + low``."""
    for at in range(0, len(high), BLOCK):
        parts = slices(high[at : at + BLOCK], low[at : at + BLOCK])
        for i in range(SLICES):
            for j in range(i, SLICES - i):
                exact = parts[i].T @ parts[j]
                into.add(exact)
                if i != j:
                    into.add(exact.T)


@dataclass
class Centre:
    """The mean S / n as a whole number and a rest in two parts."""

    n: int
    sums: list[int]

    def __post_init__(self) -> None:
        self.whole = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        over = [s - int(w) * self.n for s, w in zip(self.sums, self.whole, strict=True)]  # |over| <= n / 2
        self.rest = np.array([o / self.n for o in over])
        # what the quotient lost, from the exact remainder
        lost = [(o * d - a * self.n) / (d * self.n) for o, (a, d) in zip(over, (float(r).as_integer_ratio() for r in self.rest), strict=True)]
        self.rest_low = np.array(lost)
        self.over = np.array(over, object)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high, low = two_sum((x - self.whole).astype(np.float64), np.broadcast_to(-self.rest, x.shape))
        return high, low - self.rest_low

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
        off = x - self.whole
        if not off.size:
            return [0] * len(x)
        most = (int(np.abs(off).max()) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((off * self.n - self.over.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((off.astype(object) * self.n - self.over) ** 2).sum(axis=1)
        return [int(v) if v < 1 << 63 else None for v in exact]


def vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """The list column as rows of a matrix."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sums of each dimension, of the upper and the lower 26 bits, which no task overflows."""
    n, high, low = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            x = vectors(batch, "x")
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & ((1 << 26) - 1)).sum(axis=0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high), dtype=np.int32)), pa.array(np.full(len(high), n)), pa.array(high), pa.array(low)], names=["dim", "n", "high", "low"])


def summed(fit: DataFrame, dims: int, rows: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and outer products of what ``rows`` makes of the vectors (in two parts): a task's sums in
    double-double, merged by ``MERGED`` tasks, and their results by the driver."""
    size = width + width * width
    schema = "task int, high array<double>, low array<double>"

    def packed(total: DoubleDouble) -> pa.RecordBatch:
        part = [pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([v.ravel()], pa.list_(pa.float64())) for v in (total.high, total.low))]
        return pa.RecordBatch.from_arrays(part, names=["task", "high", "low"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = DoubleDouble.zeros(width), DoubleDouble.zeros(width, width)
        for batch in batches:
            if batch.num_rows:
                high, low = rows(vectors(batch, "x"))
                outer_products(products, high, low)
                for at in range(0, len(high), BLOCK):
                    for part in slices(high[at : at + BLOCK], low[at : at + BLOCK]):
                        sums.add(part.sum(axis=0))
        yield packed(DoubleDouble(*(np.concatenate([s, p.ravel()]) for s, p in ((sums.high, products.high), (sums.low, products.low)))))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = DoubleDouble.zeros(size)
        for batch in batches:
            for i in range(batch.num_rows):
                total.add(*(batch.column(c)[i].values.to_numpy() for c in ("high", "low")))
        yield packed(total)

    whole = DoubleDouble.zeros(size)
    tasks = min(MERGED, partitions(fit.sparkSession))
    for r in fit.mapInArrow(add_up, schema).repartition(tasks, "task").mapInArrow(merge, schema).collect():
        whole.add(np.array(r.high), np.array(r.low))
    both = whole.high + whole.low
    return both[:width], both[width:].reshape(width, width)


@dataclass
class Whitening:
    """``values`` falling, ``axes`` as columns, ``trace`` of the covariance, ``identity_error`` as measured on the fit list."""

    centre: Centre
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre.centred(x)
        return (high @ self.axes + low @ self.axes) / np.sqrt(self.values)


def fit_whitening(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on a written table of distinct vectors ``x`` of one length; None if there is nothing to fit.

    Components whose eigenvalue is within rounding of zero have no whitened value and are left out.
    """
    per_task = distinct.mapInArrow(whole_sums, "dim int, n long, high long, low long")
    sums = {r.dim: r for r in per_task.groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect()}
    if not sums:
        return None
    dims = len(sums)
    centre = Centre(sums[0].n, [(sums[d].high << 26) + sums[d].low for d in range(dims)])
    first, second = summed(distinct, dims, centre.centred, dims)
    mean = first / centre.n  # of centred rows: what rounding left
    covariance = second / centre.n - np.outer(mean, mean)
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > dims * np.finfo(float).eps * max(values[-1], 0)]
    found = Whitening(centre, values[order], axes[:, order], float(np.trace(covariance)), 0.0)
    if len(order):
        first, second = summed(distinct, dims, lambda x: ((w := found.project(x)), np.zeros_like(w)), len(order))
        mean = first / centre.n
        found.identity_error = float(np.abs(second / centre.n - np.outer(mean, mean) - np.eye(len(order))).max())
    return found


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each row and component.

    Rows whose vector is null or holds a null, a non-finite entry or one of 2^46 or more go. All
    vectors have one length; if not, the most frequent among distinct vectors counts (of equals the
    longer) and the others go. The fit list is each distinct vector once, so copies weigh nothing;
    each copy gets its rows. Null ids are kept. Fewer components come out where the covariance has
    lower rank; an empty table, or one with a single distinct vector, gives no rows. A deviation
    beyond a long is null. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    kept = embeddings.select("vec_id", scaled().alias("x")).where("x is not null")
    distinct = staged(kept.select("x").distinct(), "vectors")
    sizes = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    fitted = sizes and sizes.d and fit_whitening(distinct.where(F.size("x") == sizes.d), components)
    if not fitted or not len(fitted.values):
        return spark.createDataFrame([], schema)
    k, explained = len(fitted.values), fitted.values / fitted.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x, rows = vectors(batch, "x"), batch.num_rows
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, fitted.centre.n)), pa.array(fitted.centre.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                    pa.array(fitted.project(x).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, fitted.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.where(F.size("x") == sizes.d).mapInArrow(run, schema)
