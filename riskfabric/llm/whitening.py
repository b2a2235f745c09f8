"""Embedding whitening: principal components by Chebyshev-filtered subspace iteration, and rows projected on them at unit variance.

Only products of the covariance with a thin block are ever formed, one distributed pass each: a task centres its rows and adds X'(XQ). A Chebyshev polynomial of
the covariance, applied by its three-term recurrence, damps the unwanted part of the spectrum; QR and Rayleigh-Ritz follow, until residuals and the gap certify the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskfabric.llm.shared import written

#: Components, guard vectors beyond them, highest degree of a filter, filters at most, residual (share of the largest eigenvalue) that certifies.
COMPONENTS, GUARD, DEGREE, FILTERS, RESIDUAL = 8, 24, 12, 40, 1e-13
#: Vectors in a block, and partial sums that the driver adds up.
ROWS, PARTIALS = 4096, 64
#: Fixed-point form of an entry: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries whose fixed-point form would not fit count as non-finite.
LARGEST = float(1 << 40)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Fixed-point entries of vectors of one length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(len(vectors), -1)


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there and holds numbers only."""
    value = F.col(vector).cast("array<double>")
    fine = F.forall(value, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) <= F.lit(LARGEST)), F.lit(False)))
    return rows.where(F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0))


class Fit:
    """The fit list: blocks of fixed-point vectors, their number, sums, and products with the centred covariance."""

    def __init__(self, rows: DataFrame, vector: str = "embedding"):
        self.spark = rows.sparkSession

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    x = _matrix(batch.column(0).slice(at, ROWS))
                    yield pa.RecordBatch.from_pydict({"n": [len(x)], "x": [x.astype("<i8").tobytes()]})

        self.blocks = written(rows.select(F.col(vector).cast("array<double>")).mapInArrow(run, "n long, x binary"), "vectors")
        self.n = int(self.blocks.agg(F.sum("n")).first()[0] or 0)
        self.width = len(self.blocks.first().x) // 8 // self.blocks.first().n if self.n else 0
        self.parts = self.blocks.rdd.getNumPartitions() if self.n else 0
        self.passes = 0
        self.sums = self.total(lambda x: x.sum(axis=0, dtype=np.int64), np.int64) if self.n else np.zeros(0, np.int64)

    def total(self, part: Callable[[np.ndarray], np.ndarray], kind=np.float64) -> np.ndarray:
        """The sum over all blocks of what `part` makes of a block of fixed-point vectors. Many partial sums are added up in a second step."""
        width = self.width

        def add(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sums = None
            for value in arrays:
                sums = value if sums is None else sums + value
            if sums is not None:
                yield pa.RecordBatch.from_pydict({"sums": [np.ascontiguousarray(sums, kind).tobytes()]})

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from add(part(np.frombuffer(x.as_buffer(), "<i8").reshape(-1, width)).astype(kind) for b in batches for x in b.column(0))

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from add(np.frombuffer(x.as_buffer(), kind) for b in batches for x in b.column(0))

        sums = self.blocks.select("x").mapInArrow(first, "sums binary")
        if self.parts > PARTIALS:
            sums = sums.repartition(PARTIALS).mapInArrow(again, "sums binary")
        self.passes += 1
        return np.sum([np.frombuffer(bytes(r.sums), kind) for r in sums.collect()], axis=0, dtype=kind)

    def centred(self) -> Callable[[np.ndarray], np.ndarray]:
        return _centred(self.n, self.sums)

    def product(self, q: np.ndarray) -> np.ndarray:
        """Covariance times q."""
        centred, n = self.centred(), self.n
        return self.total(lambda x: ((c := centred(x)).T @ (c @ q) / n).ravel()).reshape(q.shape)

    def trace(self) -> float:
        centred, n = self.centred(), self.n
        return float(self.total(lambda x: np.array([(centred(x) ** 2).sum() / n]))[0])


def _centred(n: int, sums: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Vectors minus the mean; the whole part of the mean is taken off as integers."""
    whole, part = sums // n, (sums % n) / n
    return lambda x: (x - whole) - part


def chebyshev(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial of the covariance that stays small on [low, high], applied to q and scaled so that eigenvalue `top` keeps its size."""
    middle, half = (low + high) / 2, (high - low) / 2
    sigma = half / (top - middle)
    first, rate = q, sigma
    second = (product(q) - middle * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / sigma - rate)
        first, second = second, (product(second) - middle * second) * (2 * after / half) - rate * after * first
        rate = after
    return second


def components(fit: Fit, count: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, filters: int = FILTERS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues, unit eigenvectors as columns, trace): the largest ones first, as many as there are above rounding.

    Certified when every wanted pair has a residual of at most RESIDUAL of the largest eigenvalue. The block is wider than what is wanted: its last Ritz value bounds
    the damped part, and a start without any share in a wanted direction has probability zero.
    """
    trace = fit.trace() if fit.n else 0.0
    if not trace > 0:
        return np.zeros(0), np.zeros((fit.width, 0)), trace
    size = min(fit.width, count + guard)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((fit.width, size)))[0]
    best = None
    for turn in range(filters + 1):
        moved = fit.product(q)
        values, turned = np.linalg.eigh((q.T @ moved + moved.T @ q) / 2)
        values, turned = values[::-1], turned[:, ::-1]
        q, moved = q @ turned, moved @ turned
        kept = min(count, int((values > 1e-12 * values[0]).sum()))
        residual = float(np.linalg.norm(moved - q * values, axis=0)[:kept].max(initial=0.0))
        if best is None or residual < best[0]:
            best, stale = (residual, values[:kept], q[:, :kept]), 0
        else:
            stale += 1
        # A whole basis is exact after one step; rounding ends the rest.
        if residual <= RESIDUAL * values[0] or size == fit.width and turn or stale >= 2 and best[0] <= 1e-11 * values[0]:
            break
        if size < fit.width:
            high = float(values[-1])
            room = max(values[0] - high, 0.0)
            if room <= 1e-12 * values[0]:
                break  # one eigenvalue fills the block: every basis of it is right
            # Degree by how far the last wanted value lies above the damped part: a filter must not drown it in rounding.
            q = chebyshev(fit.product, q, degree, 0.0, high, float(values[0]))
        q = np.linalg.qr(q)[0]
    _, values, q = best
    q = np.linalg.qr(q)[0] * np.sign((np.linalg.qr(q)[0] * q).sum(axis=0))
    return values, q * np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0), trace


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - sums) ** 2, exact; None where it exceeds a long."""
    far = np.abs(x - sums // n).max(initial=0) + 1
    if int(far) * n < 1 << 31 and (int(far) * n) ** 2 * max(1, x.shape[1]) < 1 << 62:
        return ((n * x - sums) ** 2).sum(axis=1).tolist()
    totals = [sum((n * v - s) ** 2 for v, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [t if t < 1 << 63 else None for t in totals]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, `component` (from 1, by falling eigenvalue), `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    Vectors that are missing, empty, or hold a missing or non-finite entry (or one beyond 2 ** 40) are left out, and so are those whose length is not the most frequent one (the
    smaller of two). Entries become floor(1024 * c) + 100000; the covariance is over all remaining vectors, divisor n. `deviation` is exact, and missing where it exceeds a long.
    Components without variance (an eigenvalue below 1e-12 of the largest) cannot be scaled and are left out; so a table of equal vectors, or of one, gives no rows, as an empty
    one does. Repeated rows count every time; missing keys stay; other columns are not read. Eigenvectors have their largest entry positive.
    """
    good = usable(rows.select(F.col(key), F.col(vector).cast("array<double>").alias("_vector")), "_vector")
    sizes = good.groupBy(F.size("_vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    good = good.where(F.size("_vector") == (sizes["size"] if sizes else 0))
    fit = Fit(good, "_vector")
    values, q, trace = components(fit, count)
    n, sums, centred = fit.n, fit.sums, fit.centred() if fit.n else None
    project = q / np.sqrt(values) if len(values) else q
    error, k = 0.0, len(values)
    if k:
        moments = fit.total(lambda x: np.concatenate([(w := centred(x) @ project).sum(axis=0), (w.T @ w).ravel()]))
        mean = moments[:k] / n
        error = float(np.abs(moments[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = (values / trace).tolist() if k else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, ROWS):
                keys, x = batch.column(0).slice(at, ROWS), _matrix(batch.column(1).slice(at, ROWS))
                m = len(x)
                once = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(once)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(_deviations(x, n, sums), pa.int64()).take(pa.array(once)),
                    pa.array((centred(x) @ project).ravel()), pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error))],
                    names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = good.schema[key].dataType.simpleString()
    return good.select(key, "_vector").mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
