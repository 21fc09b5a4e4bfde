"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The fit list stays distributed as blocks of integers. One pass multiplies the centred covariance with a thin block Q
(`XᵀXQ / n`, a dimensions x columns matrix summed over tasks). Between passes the driver holds that thin matrix only.

1. Rayleigh-Ritz in the block gives the current components, and their residuals certify them.
2. Otherwise a Chebyshev polynomial of the covariance, one pass a degree, damps everything at or below the smallest Ritz
   value of the block and lifts what lies above it; QR makes the block orthonormal again.
3. Where convergence stalls, because eigenvalues at the edge of the block lie too close, the block grows. It ends at all
   dimensions, where one Rayleigh-Ritz step is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import schema_of, stored, without

#: Larger integers are held at this bound, so that sums of a block stay exact in 64 bits.
BOUND = 1 << 50
_ROWS = 512
_RANK = 1e-10  # eigenvalues below this share of the largest one count as zero
_TARGET = 2e-14  # residual over the largest eigenvalue
_ACCEPTED = 1e-10  # where rounding lets no residual fall further
_DAMPING = 1e6


@dataclass
class Whitener:
    """Sums of the fit list, and its components as columns with their eigenvalues, largest first."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    scale: float
    shift: int
    passes: int = 0
    residuals: list[float] = field(default_factory=list)  # after each Rayleigh-Ritz step, the worst of the components

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def centre(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole numbers are taken off in integers, so only the rest is rounded."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])
        return (x - np.array(whole, np.int64)) - rest

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ self.components / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n*x - S)², exact."""
        whole = [s // self.n for s in self.sums]
        near = x - np.array(whole, np.int64)
        rest = np.array([s - w * self.n for s, w in zip(self.sums, whole, strict=True)], object)
        largest = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if largest * largest * max(1, len(self.sums)) < 1 << 62:
            return ((near * self.n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return [int(v) for v in ((near.astype(object) * self.n - rest) ** 2).sum(axis=1)]


def _integers(vectors: pa.Array, size: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integers) of the vectors of `size` finite entries."""
    lengths = np.diff(vectors.offsets.to_numpy()) if len(vectors) else np.zeros(0, np.int64)
    rows = np.flatnonzero(lengths == size)
    if vectors.null_count:
        rows = rows[vectors.is_valid().to_numpy(zero_copy_only=False)[rows]]
    if not len(rows) or not size:
        return np.zeros(0, np.int64), np.zeros((0, size), np.int64)
    flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # null entries become NaN
    good = np.isfinite(values).all(axis=1)
    x = np.clip(np.floor(scale * values[good]), -BOUND, BOUND).astype(np.int64) + shift
    return rows[good], x


def _size_of(vectors: DataFrame) -> int:
    """The length that most vectors have (the longer one in a tie); 0 where there are none."""
    top = vectors.filter("v IS NOT NULL").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return top.size if top else 0


def _add_up(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of rows (i, values) by i, as a matrix. Parts meet in one shuffle; the driver gets the entries of the sum."""
    long = parts.select("i", F.posexplode("values").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(shape)
    out[long.column("i").to_numpy(), long.column("j").to_numpy()] = long.column("value").to_numpy()
    return out


def _matrix_rows(matrix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(matrix)), pa.int32()), pa.array(matrix.tolist(), pa.list_(pa.float64()))], names=["i", "values"])


def _totals(blocks: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            for x in _unpacked(batch, size):
                n += len(x)
                sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist(), strict=True)]
        totals = [Decimal(v) for v in (n, *sums)]
        yield pa.RecordBatch.from_arrays([pa.array(range(size + 1), pa.int32()), pa.array(totals, pa.decimal128(38, 0))], names=["i", "total"])

    rows = blocks.mapInArrow(add, "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    found = {r.i: int(r.total) for r in rows}
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(size)]


def _unpacked(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    for packed in batch.column("x"):
        yield np.frombuffer(packed.as_buffer(), "<i8").reshape(-1, size)


def _product(blocks: DataFrame, fitted: Whitener, q: np.ndarray) -> np.ndarray:
    """Covariance times q, by one pass over all rows."""
    size, held = fitted.dimensions, blocks.sparkSession.sparkContext.broadcast((fitted, q))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, q = held.value
        out = np.zeros(q.shape)
        for batch in batches:
            for x in _unpacked(batch, size):
                y = fitted.centre(x)
                out += y.T @ (y @ q)
        yield _matrix_rows(out)

    try:
        fitted.passes += 1
        return _add_up(blocks.mapInArrow(multiply, "i int, values array<double>"), q.shape) / fitted.n
    finally:
        held.destroy()


def _trace(blocks: DataFrame, fitted: Whitener) -> float:
    held, size = blocks.sparkSession.sparkContext.broadcast(fitted), fitted.dimensions

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = math.fsum(float((held.value.centre(x) ** 2).sum()) for batch in batches for x in _unpacked(batch, size))
        yield pa.RecordBatch.from_pydict({"total": pa.array([total], pa.float64())})

    return (blocks.mapInArrow(squares, "total double").agg(F.sum("total")).first()[0] or 0.0) / fitted.n


def _degree(lowest: float, edge: float) -> int:
    """Degree that lifts the last wanted eigenvalue by `_DAMPING` over all that lies between 0 and `edge`."""
    if edge <= 0:
        return 2
    x = max(1.0, 2 * lowest / edge - 1)
    return int(min(30, max(2, math.ceil(math.acosh(_DAMPING) / max(math.acosh(x), 1e-3)))))


def fit(
    vectors: DataFrame, components: int = 32, *, vector_col: str = "embedding", guard: int = 8, scale: float = 64.0, shift: int = 1_000_000, seed: int = 7,
) -> Whitener:
    """Components of the covariance of x = floor(scale * entry) + shift over all whole vectors.

    Whole vectors are those that are not null, hold no null or non-finite entry, and have the length that most vectors
    have (the longer in a tie). Repeated rows count as often as they stand. The block starts with `guard` columns more than
    components; it is iterated until each residual is below 2e-14 of the largest eigenvalue, or below 1e-10 where rounding
    lets none fall further. Directions without variance (below 1e-10 of the largest eigenvalue) are no components,
    so there may be fewer than asked for, and none in an empty table or where all rows are equal. Equal eigenvalues
    leave their vectors free to turn among themselves.
    """
    named = vectors.select(F.col(f"`{vector_col}`").alias("v"))
    size = _size_of(named)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = _integers(batch.column("v").slice(at, _ROWS), size, scale, shift)[1]
                if len(x):
                    yield pa.RecordBatch.from_pydict({"x": pa.array([x.astype("<i8").tobytes()], pa.binary())})

    blocks = stored(named.mapInArrow(pack, "x binary"), "whitening-blocks")
    n, sums = _totals(blocks, size) if size else (0, [])
    out = Whitener(n, sums, np.zeros(0), np.zeros((size, 0)), 0.0, scale, shift)
    if not n:
        return out
    out.trace = _trace(blocks, out)
    if out.trace <= 0:
        return out
    wanted = min(components, size)
    values, block = _iterate(blocks, out, wanted, min(size, wanted + guard), seed)
    kept = min(wanted, int((values > _RANK * values[0]).sum()))
    out.values, out.components = values[:kept], block[:, :kept]
    return out


def _iterate(blocks: DataFrame, fitted: Whitener, wanted: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Ritz values and vectors, largest first, once the first `wanted` are certified."""
    size, random = fitted.dimensions, np.random.default_rng(seed)
    q = np.linalg.qr(random.standard_normal((size, width)))[0]
    while True:
        aq = _product(blocks, fitted, q)
        gram = q.T @ aq
        values, turn = np.linalg.eigh((gram + gram.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, aq = q @ turn, aq @ turn
        errors = np.linalg.norm(aq - q * values, axis=0) / max(values[0], 1e-300)
        worst = float(errors[:wanted].max())
        fitted.residuals.append(worst)
        if q.shape[1] == size or worst <= _TARGET:
            return values, q
        seen = fitted.residuals[-3:]
        if len(seen) == 3 and worst > 0.25 * seen[0]:
            if worst <= _ACCEPTED:
                return values, q
            more = min(size, 2 * q.shape[1]) - q.shape[1]
            q = np.linalg.qr(np.hstack([q, random.standard_normal((size, more))]))[0]
            fitted.residuals.append(float("inf"))
            continue
        edge = max(float(values[-1]), 0.0)
        done = int(np.argmax(errors > _TARGET))  # leading columns that are certified stay as they are
        top, degree = float(values[done]), _degree(float(values[wanted - 1]), edge)
        q = np.linalg.qr(np.hstack([q[:, :done], _filtered(blocks, fitted, q[:, done:], aq[:, done:], q[:, :done], edge, top, degree)]))[0]


def _filtered(
    blocks: DataFrame, fitted: Whitener, q: np.ndarray, aq: np.ndarray, locked: np.ndarray, edge: float, top: float, degree: int,
) -> np.ndarray:
    """Chebyshev polynomial of `degree` on [0, edge] of the covariance, times q, scaled to stay near 1 at `top`.

    What rounding brings in along the locked columns is taken off at each step; the polynomial would lift it most.
    """
    half = max(edge / 2, top * 1e-12)
    sigma = first = half / (top - half) if top > half else 1.0
    before, now = q, (aq - half * q) * (first / half)
    for _ in range(degree - 1):
        now -= locked @ (locked.T @ now)
        after = 1 / (2 / first - sigma)
        before, now = now, (_product(blocks, fitted, now) - half * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now - locked @ (locked.T @ now)


def identity_error(vectors: DataFrame, fitted: Whitener, *, vector_col: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened rows minus the identity, measured by one more pass."""
    held, kept = vectors.sparkSession.sparkContext.broadcast(fitted), len(fitted.values)
    if not kept:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, out = held.value, np.zeros((kept + 1, kept))
        for batch in batches:
            x = _integers(batch.column(0), fitted.dimensions, fitted.scale, fitted.shift)[1]
            w = fitted.whiten(x)
            out[:kept] += w.T @ w
            out[kept] += w.sum(axis=0)
        yield _matrix_rows(out)

    sums = _add_up(vectors.select(F.col(f"`{vector_col}`").alias("v")).mapInArrow(products, "i int, values array<double>"), (kept + 1, kept)) / fitted.n
    mean = sums[kept]
    return float(np.abs(sums[:kept] - np.outer(mean, mean) - np.eye(kept)).max())


def whiten(vectors: DataFrame, fitted: Whitener, *, vector_col: str = "embedding") -> DataFrame:
    """`vectors` without rows that are not whole, plus whitened (array of double, a value for each component) and deviation
    (decimal(38,0), sum over dimensions of (n*x - S)², exact; null beyond 38 digits).

    An empty table stays empty. Repeated rows each get their values. Input columns of the two names are replaced.
    """
    out = without(vectors, "whitened", "deviation")
    names, held = out.columns, vectors.sparkSession.sparkContext.broadcast(fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = held.value
        for batch in batches:
            rows, x = _integers(batch.column(vector_col), fitted.dimensions, fitted.scale, fitted.shift)
            if not len(rows):
                continue
            kept = batch.take(pa.array(rows))
            exact = [Decimal(v) if v < 10**38 else None for v in fitted.deviation(x)]
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(fitted.whiten(x).tolist(), pa.list_(pa.float64())), pa.array(exact, pa.decimal128(38, 0))],
                names=[*names, "whitened", "deviation"])

    return out.mapInArrow(project, schema_of(out, whitened="array<double>", deviation="decimal(38,0)"))
