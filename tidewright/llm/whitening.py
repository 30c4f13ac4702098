"""Whitening of embeddings by spectrum slicing.

Sums and the covariance are added up over partitions, and only one matrix of
dimension by dimension numbers reaches the driver. There, the signs of D in
L D Lᵀ factors of the shifted matrix count the eigenvalues above a shift, which
isolates each of the leading ones in an interval of its own; Rayleigh quotient
iteration then converges to it, and two more counts, just below and just above,
certify its number. Rows are projected where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Entries become whole numbers: floor(SCALE * c) + SHIFT. Vectors with an entry of LIMIT or more in size are left out.
SCALE, SHIFT, LIMIT = 1024.0, 100_000, 2.0**40
COMPONENTS = 8
#: Eigenvalues below this share of the greatest are rounding noise and no components.
NOISE = 1e-10
#: Partial matrices are added up in so many tasks, then in one.
FAN = 32
_EPS = float(np.finfo(float).eps)
_ALPHA = (1 + math.sqrt(17)) / 8


def below(a: np.ndarray, shift: float) -> int:
    """The eigenvalues of a symmetric matrix that are less than ``shift``: the negative ones of D in L D Lᵀ, with Bunch and Kaufman's pivots."""
    a = a - shift * np.eye(len(a))
    n, k, negative = len(a), 0, 0

    def swap(i: int, j: int) -> None:
        a[[i, j]] = a[[j, i]]
        a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        step = 1
        if k + 1 < n:
            column = np.abs(a[k + 1 :, k])
            r = k + 1 + int(column.argmax())
            most = column[r - k - 1]
            if most > 0 and abs(a[k, k]) < _ALPHA * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                other = row.max()
                if abs(a[k, k]) * other < _ALPHA * most * most:
                    if abs(a[r, r]) >= _ALPHA * other:
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        step = 2
        if step == 1:
            d = a[k, k]
            negative += d < 0
            if d != 0:
                x = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(x, x / d)
        else:
            block = a[k : k + 2, k : k + 2].copy()
            det = block[0, 0] * block[1, 1] - block[0, 1] ** 2
            negative += 1 if det < 0 else 2 if block[0, 0] + block[1, 1] < 0 else 0
            x = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= x @ np.linalg.solve(block, x.T)
        k += step
    return negative


class Slicer:
    """The leading eigenpairs of a symmetric matrix, numbered by certified counts."""

    def __init__(self, a: np.ndarray):
        self.a, self.n = a, len(a)
        self.norm = float(np.abs(a).sum(1).max()) if len(a) else 0.0  # no eigenvalue is greater in size
        edge = self.norm * (1 + 1e-9) + 1e-300
        #: shift -> eigenvalues above it
        self.counts = {-edge: self.n, edge: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = self.n - below(self.a, shift)
        return self.counts[shift]

    def interval(self, k: int, width: float) -> tuple[float, float]:
        """(lo, hi) with the k-th greatest eigenvalue between, alone in it or no wider than ``width``."""
        lo = max(s for s, c in self.counts.items() if c >= k)
        hi = min(s for s, c in self.counts.items() if c < k and s > lo)
        while hi - lo > width and not (self.above(lo) == k and self.above(hi) == k - 1):
            mid = (lo + hi) / 2
            if not lo < mid < hi:  # no number between
                break
            if self.above(mid) >= k:
                lo = mid
            else:
                hi = mid
        return lo, hi

    def _inverse(self, shift: float, x: np.ndarray) -> np.ndarray:
        for nudge in (0.0, 1.0, 8.0, 64.0):
            try:
                y = np.linalg.solve(self.a - (shift + nudge * _EPS * self.norm) * np.eye(self.n), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all():
                return y
        return x

    def _apart(self, x: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
        """``x`` of length one, at right angles to the vectors found."""
        for _ in range(2):
            for v in found:
                x = x - v * (v @ x)
            x = x / max(float(np.linalg.norm(x)), 1e-300)
        return x

    def vector(self, lo: float, hi: float, found: list[np.ndarray], seed: int) -> tuple[float, np.ndarray, float]:
        """Rayleigh quotient iteration from inside the interval: (eigenvalue, vector, residual)."""
        x = self._apart(np.random.default_rng(seed).standard_normal(self.n), found)
        for _ in range(3):  # a few steps with a fixed shift bring the right vector to the front
            x = self._apart(self._inverse((lo + hi) / 2, x), found)
        best = (math.inf, 0.0, x)
        for _ in range(12):
            e = float(x @ self.a @ x)
            residual = float(np.linalg.norm(self.a @ x - e * x))
            if residual >= best[0]:
                break
            best = (residual, e, x)
            x = self._apart(self._inverse(e, x), found)
        return best[1], best[2], best[0]

    def leading(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(eigenvalues, vectors as columns) from the greatest; those of rounding size are left out."""
        values: list[float] = []
        vectors: list[np.ndarray] = []
        for k in range(1, min(count, self.n) + 1 if self.norm else 1):
            lo, hi = self.interval(k, 1e-12 * self.norm)
            while True:
                e, x, residual = self.vector(lo, hi, vectors, k)
                near = max(4 * residual, 64 * _EPS * self.norm)
                if lo - near <= e <= hi + near and self.above(e + near) < k <= self.above(e - near):
                    break
                if hi - lo <= 1e-13 * self.norm:
                    raise ArithmeticError(f"eigenvalue {k} can't be told apart")
                mid = (lo + hi) / 2  # another eigenvalue attracted the iteration: a narrower interval
                lo, hi = (mid, hi) if self.above(mid) >= k else (lo, mid)
            if e <= NOISE * max(values[:1], default=e) or e <= 0:
                break
            values.append(e)
            vectors.append(x * np.sign(x[np.abs(x).argmax()]))
        return np.array(values), np.array(vectors).T.reshape(self.n, len(vectors))


def whole_numbers(flat: np.ndarray, width: int) -> np.ndarray:
    """Entries of vectors as whole numbers, a row per vector."""
    return (np.floor(SCALE * flat.reshape(-1, width))).astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Per row the sum of squares of n x - S, exact; None where it doesn't fit 64 bits."""
    if not len(x):
        return []
    if n * int(np.abs(x).max()) + int(np.abs(sums).max()) < 2**62:
        y = n * x - sums
        if int(np.abs(y).max()) ** 2 * x.shape[1] < 2**63:
            return (y * y).sum(1).tolist()
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def _vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, v) of the vectors that are whole, and their length: the commonest one, the greatest on a tie."""
    v = F.col(vector).cast("array<double>")
    # NaN is greater than any number, and a comparison with null isn't true
    rows = df.select(F.col(key).alias("key"), v.alias("v")).where(F.forall("v", lambda c: F.abs(c) < LIMIT) & (F.size("v") > 0))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()  # one row
    d = lengths[0]["d"] if lengths else 0
    return rows.where(F.size("v") == d), d


def _batches(width: int, use: Callable[[np.ndarray], None]) -> Callable:
    """Hands the vectors of each batch to ``use``, a few thousand at a time."""

    def each(b: pa.RecordBatch, column: int = 0) -> None:
        flat = b.column(column).flatten().to_numpy(zero_copy_only=False)
        step = width * max(1, 2**22 // width)
        for i in range(0, len(flat), step):
            use(whole_numbers(flat[i : i + step], width))

    return each


def sums_of(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """(n, sums by dimension) of the whole numbers; one row of each partition is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)

        def use(x: np.ndarray) -> None:
            nonlocal n, total
            n += len(x)
            total = total + x.sum(0)

        each = _batches(d, use)
        for b in batches:
            each(b)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], ["n", "s"])

    part = rows.select("v").mapInArrow(run, "n long, s array<long>")
    got = part.select("n", F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).orderBy("i").collect()  # a row per dimension
    return (got[0]["n"], np.array([r["x"] for r in got], np.int64)) if got else (0, np.zeros(d, np.int64))


def covariance(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """The covariance, divisor n, of the whole numbers, centred before they are multiplied."""
    d, mean = len(sums), sums / n

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))

        def use(x: np.ndarray) -> None:
            nonlocal total
            y = x - mean
            total = total + y.T @ y

        each = _batches(d, use)
        for b in batches:
            each(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * d)
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = rows.select("v").mapInArrow(gram, "m binary")
    one = parts.repartition(FAN).mapInArrow(add, "m binary").repartition(1).mapInArrow(add, "m binary").collect()  # one matrix
    return np.frombuffer(one[0]["m"]).reshape(d, d) / n


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Entries c become floor(1024 c) + 100000. Vectors are left out that are null
    or empty, hold null or non-finite entries or some of 2**40 or more in size, or
    are not of the commonest length. There are as many components as ``components``, the
    length and the rank allow: none for equal vectors, and then no rows. Repeated
    keys and vectors count as often as they occur; a null key stays null.
    ``deviation`` is null where it doesn't fit a long. Other columns are not used.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "whitening")
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = _vectors(df, key, vector)
    n, sums = sums_of(rows, d) if d else (0, np.zeros(0, np.int64))
    if not n:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    v = covariance(rows, n, sums)
    values, axes = Slicer(v).leading(components)
    if not len(values):
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    mean, scale = sums / n, axes / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            deviation: list[int | None] = []
            out: list[np.ndarray] = []

            def use(x: np.ndarray) -> None:
                deviation.extend(deviations(x, n, sums))
                out.append((x - mean) @ scale)

            _batches(d, use)(b, 1)
            w = np.concatenate(out).ravel() if out else np.zeros(0)
            at = pa.array(np.arange(0, len(w) + 1, len(values)), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(at, pa.array(w))], ["key", "deviation", "w"])

    done = scratch.save(rows.mapInArrow(project, f"key {kind}, deviation long, w array<double>"), "projected")
    places = range(len(values))
    w = [F.col("w")[i] for i in places]
    centre = done.agg(*[F.avg(x) for x in w]).first()
    square = done.agg(*[F.avg((w[i] - centre[i]) * (w[j] - centre[j])) for i in places for j in places if j <= i]).first()
    error = max(abs(s - (i == j)) for s, (i, j) in zip(square, [(i, j) for i in places for j in places if j <= i], strict=True))
    share = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    out = done.select("key", "deviation", F.posexplode("w").alias("i", "whitened"))
    return out.select(
        F.col("key").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share[F.col("i")].alias("explained"), F.lit(float(error)).alias("identity_error")
    )
