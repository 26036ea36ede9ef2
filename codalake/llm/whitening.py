"""Embedding whitening by Chebyshev-filtered subspace iteration.

Entries become whole numbers floor(scale * c), and the fit list holds each distinct vector once. The leading
eigenvectors of its covariance V are found without forming V: a block of components + guard vectors is
multiplied by V in distributed passes (each task centres its vectors and adds up its share of X'XQ, matrices of
d x block numbers meet in groups and then in the driver). A Chebyshev polynomial of V, by its three-term recurrence, damps
the unwanted part of the spectrum, from 0 to the smallest Ritz value of the block; then QR and Rayleigh-Ritz. This
repeats until the residuals |Vq - eq| of the wanted pairs are at the rounding errors of doubles.

Small residuals show eigenpairs, but not that they are the leading ones. So the result is certified: with the found
directions taken out, (e_k + tolerance) I - V must have a Cholesky factor, which holds only if no other eigenvalue is
above the last wanted one. If it has none, the block gets new random directions and the iteration goes on. This check
multiplies V by the columns of the identity, in blocks, and takes d * d numbers in the driver (d is the vectors' length).

Sums, trace and deviations are exact (whole numbers of any size). The shuffle moves each distinct vector of each task
once, packed to 2 bytes an entry where the entries allow it; copies are combined before it.

Results for unusual input: rows whose vector is null, empty, or holds null or non-finite entries are dropped; of vectors
of several lengths those of the most frequent length among the distinct ones stay (of equal ones, the longer);
entries beyond 64 bits take the nearest number that fits; rows that are there twice, or have a null id, give their rows each
time; with d < components there are d components; a component without variance (as all are where there is one distinct
vector) has whitened null and explained 0; equal eigenvalues have any orthonormal directions, the same for all rows;
deviation is null beyond 38 digits; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tune

SCALE = 256
COMPONENTS = 4
GUARD = 8
DEGREE = 10
#: Residuals, as a share of the largest eigenvalue, that count as rounding errors.
TOLERANCE = 2e-14
#: Rounds of filter, QR and Rayleigh-Ritz before the iteration gives up with an error.
MOST_ROUNDS = 200
#: Partial matrices that come to the driver at a time; beyond it they are added up in groups first.
PARTS = 64
#: Columns of the identity that one pass of the certificate multiplies.
CHECK_COLUMNS = 256

_BIG = 1 << 63


def whole_rows(column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, whole numbers) of the good vectors of an Arrow list column, one block for each length."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    column = column.drop_null()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten().cast(pa.float64())
    values = (values.fill_null(float("nan")) if values.null_count else values).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        c = values[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            v = np.floor(c[good] * scale)
        inside = (v > -float(_BIG)) & (v < float(_BIG))
        x = np.where(inside, v, 0.0).astype(np.int64)
        if not inside.all():
            x = np.where(inside, x, np.where(v > 0, _BIG - 1, -_BIG))
        yield there[rows[good]], x


def packed(x: np.ndarray) -> list[bytes]:
    """Each vector in as few bytes an entry (2, 4 or 8) as hold it: equal vectors have equal bytes."""
    out: list[bytes] = [b""] * len(x)
    low, high = x.min(axis=1), x.max(axis=1)
    left = np.ones(len(x), bool)
    for kind in (np.int16, np.int32, np.int64):
        info = np.iinfo(kind)
        rows = np.flatnonzero(left & (low >= info.min) & (high <= info.max))
        left[rows] = False
        data = x[rows].astype(kind)
        for i, row in zip(rows.tolist(), data, strict=True):
            out[i] = row.tobytes()
    return out


def unpacked(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    """The vectors of packed() as blocks of 64-bit numbers."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for kind in (np.int16, np.int32, np.int64):
        some = column.filter(pa.array(sizes == d * np.dtype(kind).itemsize))
        if len(some):
            yield np.frombuffer(b"".join(some.to_pylist()), kind).reshape(-1, d).astype(np.int64)


def fit_list(vectors: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """d, x: each distinct vector once, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in whole_rows(batch.column(0), scale):
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(x), pa.int32()), pa.array(packed(x), pa.binary())], names=["d", "x"])

    return vectors.select(F.col(f"`{vector_col}`").alias("v")).where("v IS NOT NULL").mapInArrow(run, "d int, x binary").distinct()


def _totals(fit: DataFrame, d: int) -> tuple[int, int, list[int]]:
    """n, the sum of squared entries and the sums S, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, squares, sums = 0, 0, [0] * d
        for batch in batches:
            for x in unpacked(batch.column("x"), d):
                most = max(abs(int(x.min())), abs(int(x.max())), 1)
                exact = x if most * most * x.size < 1 << 62 else x.astype(object)
                n += len(x)
                squares += int((exact * exact).sum())
                sums = [a + int(b) for a, b in zip(sums, exact.sum(axis=0), strict=True)]
        values = [Decimal(v) for v in (n, squares >> 64, squares & ((1 << 64) - 1), *sums)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["k", "v"])

    rows = fit.select("x").mapInArrow(run, "k int, v decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v")).collect()  # d + 3 rows
    got = [int(r["v"]) for r in sorted(rows, key=lambda r: r["k"])]
    return got[0], (got[1] << 64) + got[2], got[3:]


class Covariance:
    """The covariance V of the fit list as an operator: products with blocks of vectors, in distributed passes."""

    def __init__(self, fit: DataFrame, d: int, mean: np.ndarray, n: int):
        self.fit, self.d, self.mean, self.n, self.passes = fit.select("x"), d, mean, n, 0
        self.parts = self.fit.rdd.getNumPartitions()

    def summed(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum of of(centred vectors) over all blocks of vectors: a matrix of that shape from each task, added up in
        groups of tasks first where there are many."""
        d, mean = self.d, self.mean
        self.passes += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in batches:
                for x in unpacked(batch.column("x"), d):
                    total += of(x - mean)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "m"])

        def meet(table: pa.Table) -> pa.Table:
            table = table.sort_by("part")
            total = sum(np.frombuffer(m.as_py()) for m in table.column("m"))
            return pa.table({"part": table.column("part").slice(0, 1), "m": pa.array([total.tobytes()], pa.binary())})

        rows = self.fit.mapInArrow(run, "part int, m binary")
        if self.parts > PARTS:
            rows = rows.groupBy(F.col("part") % PARTS).applyInArrow(meet, "part int, m binary")
        got = sorted(rows.collect(), key=lambda r: r["part"])  # PARTS matrices at most
        return sum((np.frombuffer(r["m"]) for r in got), np.zeros(int(np.prod(shape)))).reshape(shape)

    def times(self, q: np.ndarray) -> np.ndarray:
        return self.summed(lambda x: x.T @ (x @ q), q.shape) / self.n


def chebyshev(times: Callable[[np.ndarray], np.ndarray], x: np.ndarray, vx: np.ndarray, high: float, top: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of V times x, small on [0, high] and scaled to 1 at top. vx: V x, if degree > 0."""
    half = high / 2
    sigma = first = half / (top - half)
    y = (vx - half * x) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        x, y = y, (times(y) - half * y) * (2 * after / half) - sigma * after * x
        sigma = after
    return y


def ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz: (values by fall, vectors, V times these)."""
    h = q.T @ vq
    values, u = np.linalg.eigh((h + h.T) / 2)
    u = u[:, ::-1]
    return values[::-1], q @ u, vq @ u


def certified(cov: Covariance, values: np.ndarray, q: np.ndarray) -> bool:
    """Whether no eigenvalue but the found ones is above the last of them: by a Cholesky factor of V with the found directions taken out."""
    if q.shape[1] >= cov.d:
        return True
    eye = np.eye(cov.d)
    v = np.hstack([cov.times(eye[:, i : i + CHECK_COLUMNS]) for i in range(0, cov.d, CHECK_COLUMNS)])
    rest = v - q @ (q.T @ v)
    rest -= (rest @ q) @ q.T
    try:
        np.linalg.cholesky((values[-1] + 1e-9 * max(values[0], 1e-300)) * eye - (rest + rest.T) / 2)
        return True
    except np.linalg.LinAlgError:
        return False


def leading(cov: Covariance, k: int, guard: int = GUARD, degree: int = DEGREE, tolerance: float = TOLERANCE, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the k largest eigenvalues, certified."""
    r = np.random.default_rng(seed)
    width = min(cov.d, k + guard)
    k = min(k, cov.d)
    q = np.linalg.qr(r.standard_normal((cov.d, width)))[0]
    vq = cov.times(q)
    best, stalled = np.inf, 0
    for _ in range(MOST_ROUNDS):
        values, q, vq = ritz(q, vq)
        top, high = max(values[0], 0.0), max(values[-1], 0.0)
        left = np.linalg.norm(vq[:, :k] - q[:, :k] * values[:k], axis=0).max()
        stalled = stalled + 1 if left > best / 2 else 0
        best = min(best, left)
        # Done at the rounding errors, or where further rounds no longer lower residuals that are near them.
        if left <= tolerance * top or (stalled >= 2 and left <= 1e-9 * top):
            if certified(cov, values[:k], q[:, :k]):
                return np.maximum(values[:k], 0.0), q[:, :k]
            q[:, k:] = r.standard_normal((cov.d, width - k))
            y, best, stalled = q, np.inf, 0
        elif high <= 1e-12 * top or high >= top:
            y = vq  # nothing to damp, or no spread to tell by: a plain power step
        else:
            y = chebyshev(cov.times, q, vq, high, top, degree)
        q = np.linalg.qr(y)[0]
        q = np.linalg.qr(q)[0]
        vq = cov.times(q)
    raise RuntimeError(f"no certified eigenvectors after {MOST_ROUNDS} rounds")


@dataclass
class Basis:
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # d x components
    identity_error: float
    passes: int

    def __post_init__(self):
        self.d = len(self.sums)
        self.mean = np.array([s / self.n for s in self.sums])
        #: Components with variance; the others cannot be scaled to 1.
        self.live = self.values > 1e-13 * self.trace
        self.axes = self.vectors / np.sqrt(np.where(self.live, self.values, 1.0))


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, guard: int = GUARD, degree: int = DEGREE) -> Basis | None:
    """The basis of the distinct vectors; None without any."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    tune(vectors.sparkSession)
    listed = scratch.keep("fit", fit_list(vectors, vector_col, scale))
    sizes = listed.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return None
    d = sizes[0]["d"]
    listed = listed.where(F.col("d") == d)
    n, squares, sums = _totals(listed, d)
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)
    cov = Covariance(listed, d, np.array([s / n for s in sums]), n)
    values, axes = leading(cov, components, guard, degree)
    basis = Basis(n, sums, trace, values, axes, 0.0, 0)
    w = basis.axes[:, basis.live]
    k = w.shape[1]
    if k:

        def moments(x: np.ndarray) -> np.ndarray:
            y = x @ w
            return np.vstack([y.T @ y, y.sum(axis=0)])

        m = cov.summed(moments, (k + 1, k)) / n
        basis.identity_error = float(np.abs(m[:k] - np.outer(m[k], m[k]) - np.eye(k)).max())
    basis.passes = cov.passes
    scratch.drop_all_but()
    return basis


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """For each vector the sum over dimensions of (n * x - S)^2, exactly."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums)
    if most < 1 << 54 and x.shape[1] <= 256:
        t = np.abs(n * x - np.array(sums, np.int64))
        high, low = t >> 27, t & ((1 << 27) - 1)
        a, b, c = (high * high).sum(axis=1).tolist(), (high * low).sum(axis=1).tolist(), (low * low).sum(axis=1).tolist()
        return [(i << 54) + (j << 28) + k for i, j, k in zip(a, b, c, strict=True)]
    t = x.astype(object) * n - np.array(sums, object)
    return (t * t).sum(axis=1).tolist()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, guard: int = GUARD, degree: int = DEGREE) -> DataFrame:
    """A row for each good row of vectors and component: id_col, component (from 1, by falling eigenvalue), n, deviation
    (decimal), whitened, explained, identity_error."""
    kind = dict(vectors.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    basis = fit(vectors, vector_col, components, scale, guard, degree)
    if basis is None:
        return vectors.sparkSession.createDataFrame([], schema)
    k = len(basis.values)
    explained = basis.values / basis.trace if basis.trace else np.zeros(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole_rows(batch.column(1), scale):
                if not len(x) or x.shape[1] != basis.d:
                    continue
                n = len(x)
                w = ((x - basis.mean) @ basis.axes).ravel()
                off = [v if v < 10**38 else None for v in deviations(x, basis.n, basis.sums)]
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(at, k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, basis.n, np.int64)),
                        pa.array([None if v is None else Decimal(v) for v in off], pa.decimal128(38, 0)).take(each),
                        pa.array(w, mask=np.tile(~basis.live, n)),
                        pa.array(np.tile(explained, n)),
                        pa.array(np.full(n * k, basis.identity_error)),
                    ],
                    names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").alias("__vector")).where("__vector IS NOT NULL").mapInArrow(run, schema)
