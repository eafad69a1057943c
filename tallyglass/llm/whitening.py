"""Whitening of embeddings on their leading components, found by spectrum slicing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parked, private_names

#: Entries count in steps of 1 / STEPS; a fixed value of the operator.
STEPS = 256
#: Fixed-point entries end here, so that differences of two stay within 64 bits.
LIMIT = 1 << 61


class Slicer:
    """Leading eigenpairs of a symmetric matrix by counting eigenvalues above shifts."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = np.asarray(matrix, np.float64)
        self.size = len(self.matrix)
        radius = np.abs(self.matrix).sum(axis=1).max() if self.size else 0.0
        self.scale = float(radius)
        self.noise = 8 * np.finfo(float).eps * max(self.scale, np.finfo(float).tiny)
        self.counted: dict[float, int] = {}

    def above(self, shift: float) -> int:
        """Number of eigenvalues over ``shift``: positive pivots of the shifted matrix (law of inertia)."""
        if shift not in self.counted:
            self.counted[shift] = positive_pivots(self.matrix - shift * np.eye(self.size))
        return self.counted[shift]

    def bracket(self, number: int) -> tuple[float, float, int]:
        """(low, high, m): the interval holds m eigenvalues, of which ``number`` is the first from above.

        m is 1 unless eigenvalues lie closer together than doubles can tell.
        """
        edge = self.scale + 16 * self.noise
        known = {-edge: self.size, edge: 0, **self.counted}
        low = max(s for s, c in known.items() if c >= number)
        high = min(s for s, c in known.items() if c < number and s > low)
        while known[low] - known[high] > 1 and high - low > 4 * self.noise:
            middle = (low + high) / 2
            known[middle] = self.above(middle)
            if known[middle] >= number:
                low = middle
            else:
                high = middle
        return low, high, known[low] - known[high]

    def refine(self, low: float, high: float, number: int, found: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """The eigenpair of an interval: Rayleigh quotient iteration, begun anew in a half if counts refuse its result."""
        while True:
            middle = (low + high) / 2
            vector = np.random.default_rng(number).standard_normal(self.size)
            vector = self.solved(self.solved(vector, middle, found), middle, found)
            value, error = self.quotient(vector)
            stalled = 0
            for _ in range(60):
                closer = self.solved(vector, value, found)
                closer_value, closer_error = self.quotient(closer)
                stalled = 0 if closer_error < error / 2 else stalled + 1
                if closer_error < error:
                    vector, value, error = closer, closer_value, closer_error
                if stalled > (0 if error <= self.noise else 8):
                    break
            if high - low <= 4 * self.noise or self.certified(value, error, number):
                return value, vector
            if self.above(middle) >= number:
                low = middle
            else:
                high = middle

    def quotient(self, vector: np.ndarray) -> tuple[float, float]:
        image = self.matrix @ vector
        value = float(vector @ image)
        return value, float(np.linalg.norm(image - value * vector))

    def certified(self, value: float, error: float, number: int) -> bool:
        """Whether the pair is exact to rounding, and the counts just below and above it give its number."""
        margin = 16 * self.noise + 2 * error
        return error <= 16 * self.noise and self.above(value - margin) >= number > self.above(value + margin)

    def solved(self, vector: np.ndarray, shift: float, found: list[np.ndarray]) -> np.ndarray:
        """One step of inverse iteration, kept square to the vectors found before."""
        for nudge in (0.0, 1.0, -2.0, 8.0):
            try:
                out = np.linalg.solve(self.matrix - (shift + nudge * self.noise) * np.eye(self.size), vector)
            except np.linalg.LinAlgError:
                continue
            with np.errstate(invalid="ignore"):
                out = out / max(float(np.abs(out).max()), np.finfo(float).tiny)
            size = np.linalg.norm(out)
            if np.isfinite(size) and size > 0:
                out = out / size
                for _ in range(2):
                    for other in found:
                        out = out - (other @ out) * other
                size = np.linalg.norm(out)
                if size > 1e-8:
                    return out / size
                vector = np.random.default_rng(len(found) + int(nudge) + 99).standard_normal(self.size)
        for other in found:
            vector = vector - (other @ vector) * other
        return vector / np.linalg.norm(vector)

    def leading(self, most: int) -> list[tuple[float, np.ndarray]]:
        """(eigenvalue, unit vector) of the largest eigenvalues, by falling value.

        The counts around every value certify its number. Equal eigenvalues give some square basis of
        their space. The largest entry of a vector is positive.
        """
        pairs: list[tuple[float, np.ndarray]] = []
        while len(pairs) < min(most, self.size):
            number = len(pairs) + 1
            low, high, together = self.bracket(number)
            found = [v for _, v in pairs]
            group = []
            for k in range(min(together, self.size - len(pairs))):
                group.append(self.refine(low, high, number + k, [*found, *(v for _, v in group)]))
            for k, (value, vector) in enumerate(sorted(group, key=lambda p: -p[0])):
                if not self.certified(*self.quotient(vector), number + k):
                    raise ArithmeticError(f"eigenvalue {number + k} is not certified: {value}")
                pairs.append((value, vector * np.sign(vector[np.argmax(np.abs(vector))])))
        return pairs[:most]


def positive_pivots(matrix: np.ndarray) -> int:
    """Positive eigenvalues of a symmetric matrix: LDLᵀ with pivots of one or two rows (Bunch and Kaufman)."""
    a, n, k, positive, share = matrix.copy(), len(matrix), 0, 0, (1 + 17**0.5) / 8
    while k < n:
        pivot, width = abs(a[k, k]), 1
        if k < n - 1:
            r = k + 1 + int(np.argmax(np.abs(a[k + 1 :, k])))
            most = abs(a[r, k])
            if max(pivot, most) == 0:
                k += 1
                continue
            if pivot < share * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                widest = row.max()
                if pivot * widest < share * most * most:
                    width = 1 if abs(a[r, r]) >= share * widest else 2
                    to = k + width - 1
                    a[[to, r]] = a[[r, to]]
                    a[:, [to, r]] = a[:, [r, to]]
        block, side = a[k : k + width, k : k + width], a[k + width :, k : k + width]
        if width == 1:
            positive += bool(block[0, 0] > 0)
            if block[0, 0] != 0:
                a[k + 1 :, k + 1 :] -= np.outer(side[:, 0], side[:, 0]) / block[0, 0]  # stays symmetric to the last bit
        else:
            # The choice of the pivot makes its determinant negative: one eigenvalue on either side.
            positive += 1
            gone = side @ np.linalg.solve(block, side.T)
            a[k + 2 :, k + 2 :] -= (gone + gone.T) / 2
        k += width
    return positive


def _vectors(batch: pa.RecordBatch, place: int, size: int) -> np.ndarray:
    return batch.column(place).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


class Moments:
    """Count and sums of the fit list; ``middle`` is its rounded mean and ``rest`` what the sums have beyond it."""

    def __init__(self, count: int, sums: list[int]):
        self.count, self.sums = count, sums
        self.middle = np.array([(2 * s + count) // (2 * count) for s in sums], np.int64)
        self.rest = [s - count * int(m) for s, m in zip(sums, self.middle)]
        self.shift = np.array([r / count for r in self.rest])

    def centred(self, vectors: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once: differences of whole numbers are exact."""
        return (vectors - self.middle).astype(np.float64) - self.shift

    def deviations(self, vectors: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - S) ** 2, by way of x - middle."""
        near = vectors - self.middle
        most, rest = int(np.abs(near).max(initial=0)), max((abs(r) for r in self.rest), default=0)
        whole = len(self.rest) * max(most, 1) * max(most, rest, 1) >= 1 << 63
        near = near.astype(object) if whole else near
        squares = (near * near).sum(axis=1).tolist()
        mixed = (near @ np.array(self.rest, object if whole else np.int64)).tolist()
        own = sum(r * r for r in self.rest)
        return [self.count * self.count * int(a) - 2 * self.count * int(b) + own for a, b in zip(squares, mixed)]


def _sums(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    count, sums = 0, [0] * size
    for batch in batches:
        x = _vectors(batch, 0, size)
        count += len(x)
        whole = len(x) * int(np.abs(x).max(initial=0)) >= 1 << 63
        sums = [a + int(b) for a, b in zip(sums, (x.astype(object) if whole else x).sum(axis=0))]
    if count:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(size), pa.int32()), pa.array([count] * size, pa.int64()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["i", "n", "total"]
        )


def _products(batches: Iterator[pa.RecordBatch], size: int, project: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Sums of products of all pairs of columns (i <= j), and of the columns themselves (j = -1)."""
    products, sums, width = 0.0, 0.0, 0
    for batch in batches:
        y = project(_vectors(batch, 0, size))
        products, sums, width = products + y.T @ y, sums + y.sum(axis=0), y.shape[1]
    if width:
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[i, np.arange(width)], pa.int32()), pa.array(np.r_[j, np.full(width, -1)], pa.int32()), pa.array(np.r_[products[i, j], sums])], names=["i", "j", "v"]
        )


def covariance(fit: DataFrame, size: int, count: int, width: int, project: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Covariance (divisor ``count``) of centred columns; ``width`` squared numbers come to the driver."""
    parts = fit.mapInArrow(partial(_products, size=size, project=project), "i int, j int, v double")
    out, mean = np.zeros((width, width)), np.zeros(width)
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        if j < 0:
            mean[i] = v / count
        else:
            out[i, j] = out[j, i] = v / count
    return out - np.outer(mean, mean)


class Projection:
    """Projects centred vectors on unit components and divides by the roots of their eigenvalues."""

    def __init__(self, moments: Moments, values: list[float], vectors: np.ndarray):
        self.moments, self.values, self.vectors = moments, values, vectors
        self.live = [v > 0 for v in values]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        roots = np.sqrt([v if ok else 1.0 for v, ok in zip(self.values, self.live)])
        return self.moments.centred(x) @ self.vectors.T / roots


def _whitened(batches: Iterator[pa.RecordBatch], size: int, project: Projection, explained: list, error: float, names: list[str]) -> Iterator[pa.RecordBatch]:
    k = len(explained)
    for batch in batches:
        x = _vectors(batch, 1, size)
        deviations = project.moments.deviations(x)
        rows = len(x)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                pa.array(np.full(rows * k, project.moments.count, np.int64)),
                pa.array([d if d < 1 << 63 else None for d in deviations for _ in range(k)], pa.int64()),
                pa.array(project(x).ravel(), mask=np.tile(~np.array(project.live), rows)),
                pa.array(explained * rows, pa.float64()),
                pa.array(np.full(rows * k, error)),
                pa.array([str(d) for d in deviations for _ in range(k)]),
            ],
            names=names,
        )


def fixed_point(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x): whole-number vectors of the rows whose vector has only finite entries."""
    entries = F.col("v").cast("array<double>")
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    step = F.transform(entries, lambda c: F.floor(F.greatest(F.least(c * STEPS, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    named = rows.select(F.col(key).alias("k"), F.col(vector).alias("v"))
    return named.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True))).select("k", step.alias("x"))


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """Whitened coordinates of every vector on the leading components of the distinct vectors.

    Vectors that are null or hold null, NaN or infinite entries are left out; so are those of another
    length than most have (of equally common lengths the longest counts, and never 0). Entries become
    whole steps of 1 / 256, at most 2 ** 61 in size. The covariance is that of the distinct
    vectors, each once, however often it is repeated. It is cut by inertia counts on the driver:
    ``dimension ** 2`` numbers. One row for each row and component, numbered from 1, comes out with
    ``key``, ``n`` (vectors fitted), ``deviation`` (null where it passes 64 bits), ``whitened`` (null
    where the eigenvalue is 0), ``explained`` (null if nothing varies), ``identity_error`` and
    ``deviation_text``, the exact number in digits. Repeated and null keys are kept. Other columns are ignored; an output
    column that clashes with ``key`` gets an underscore. An empty table gives no rows.
    """
    names = [key, *private_names([key], "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_text")]
    kinds = [rows.schema[key].dataType.simpleString(), "int", "long", "long", "double", "double", "double", "string"]
    schema = ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds))
    points = fixed_point(rows, key, vector)
    lengths = points.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return rows.sparkSession.createDataFrame([], schema)
    size = int(lengths[0]["d"])
    points = points.where(F.size("x") == size)
    fit = parked(points.select("x").distinct(), "whitening")
    sums = fit.mapInArrow(partial(_sums, size=size), "i int, n long, total decimal(38,0)")
    totals = {r["i"]: (r["n"], int(r["total"])) for r in sums.groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    moments = Moments(totals[0][0], [totals[i][1] for i in range(size)])
    spread = covariance(fit, size, moments.count, size, moments.centred)
    trace = float(np.trace(spread))
    pairs = Slicer(spread).leading(components)
    values = [v if v > 1e-14 * trace else 0.0 for v, _ in pairs]
    project = Projection(moments, values, np.array([v for _, v in pairs]))
    live = [k for k, ok in enumerate(project.live) if ok]
    error = 0.0
    if live:
        seen = covariance(fit, size, moments.count, len(pairs), project)[np.ix_(live, live)]
        error = float(np.abs(seen - np.eye(len(live))).max())
    explained = [v / trace if trace > 0 else None for v in values]
    work = partial(_whitened, size=size, project=project, explained=explained, error=error, names=names)
    return points.mapInArrow(work, schema)
