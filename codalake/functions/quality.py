"""Picture quality: pooled PSNR, whole-plane SSIM, plane digests and rate-distortion deltas."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The SSIM constants for 8 bits, and the PSNR of equal frames.
C1, C2, EQUAL = 6.5025, 58.5225, 100.0


def psnr(a: list[bytes], b: list[bytes]) -> float:
    """Of all planes together: squared errors are summed before the logarithm."""
    x, y = (np.frombuffer(b"".join(p), np.uint8).astype(np.int64) for p in (a, b))
    error = int(((x - y) ** 2).sum())
    return EQUAL if error == 0 else min(EQUAL, 10 * math.log10(255.0**2 * len(x) / error))


def ssim_global(a: list[bytes], b: list[bytes]) -> float:
    """One window per plane with population variances, planes weighted by their pixels; not the usual windowed SSIM."""
    total = pixels = 0.0
    for p, q in zip(a, b, strict=True):
        x, y = np.frombuffer(p, np.uint8).astype(float), np.frombuffer(q, np.uint8).astype(float)
        mx, my = x.mean(), y.mean()
        cov = ((x - mx) * (y - my)).mean()
        value = (2 * mx * my + C1) * (2 * cov + C2) / ((mx * mx + my * my + C1) * (x.var() + y.var() + C2))
        total, pixels = total + value * len(x), pixels + len(x)
    return total / pixels if pixels else 0.0


def frame_quality(*planes: str) -> Column:
    """psnr and ssim of two frames given by the columns of their planes: y, u, v of one, then of the other."""

    @F.arrow_udf("struct<psnr:double,ssim:double>")
    def run(ay: pa.Array, au: pa.Array, av: pa.Array, by: pa.Array, bu: pa.Array, bv: pa.Array) -> pa.Array:
        # One pair of frames at a time; the others stay in the batch as they came.
        made = []
        for row in zip(ay, au, av, by, bu, bv, strict=True):
            p = [bytes(x.as_py()) for x in row]
            made.append((psnr(p[:3], p[3:]), ssim_global(p[:3], p[3:])))
        return pa.StructArray.from_arrays([pa.array([m[k] for m in made], pa.float64()) for k in range(2)], names=["psnr", "ssim"])

    return run(*planes)


def adler32(plane: Column | str) -> Column:
    @F.pandas_udf("bigint")
    def run(planes: pd.Series) -> pd.Series:
        return planes.map(lambda p: None if p is None else zlib.adler32(bytes(p)))

    return run(plane)


def plane_md5(plane: Column) -> Column:
    return F.md5(plane)


def visible(plane: bytes, stride: int, width: int, height: int) -> bytes:
    """The plane without the padding of its rows."""
    return b"".join(plane[r * stride : r * stride + width] for r in range(height))


def visible_rows(plane: Column, stride: int, width: int, height: int | Column) -> Column:
    """The same as an expression."""
    height = F.lit(height) if isinstance(height, int) else height
    rows = F.transform(F.sequence(F.lit(0), height - 1), lambda r: F.hex(F.substring(plane, r * stride + 1, F.lit(width))))
    return F.when(height > 0, F.unhex(F.array_join(rows, ""))).otherwise(F.lit(b""))


def _points(points) -> tuple[np.ndarray, np.ndarray]:
    rates, psnrs = (np.array(x, float) for x in zip(*sorted(points), strict=True)) if points else (np.zeros(0), np.zeros(0))
    if len(rates) < 4:
        raise ValueError("a curve needs four points")
    if not (np.isfinite(rates).all() and np.isfinite(psnrs).all() and (rates > 0).all()):
        raise ValueError("rates must be positive and finite")
    if (np.diff(rates) == 0).any():
        raise ValueError("a rate comes twice")
    return np.log10(rates), psnrs


def _area(x: np.ndarray, y: np.ndarray, low: float, high: float) -> float:
    """Integral of the least-squares cubic through the points."""
    mid = x.mean()
    fit = np.polynomial.Polynomial(np.linalg.lstsq(np.vander(x - mid, 4, increasing=True), y, rcond=None)[0]).integ()
    return float(fit(high - mid) - fit(low - mid))


def bd_rate(reference, test) -> float:
    """Bjontegaard delta rate in percent over the common PSNR range. Points are (rate, psnr)."""
    (ra, pa), (rb, pb) = _points(reference), _points(test)
    low, high = max(pa.min(), pb.min()), min(pa.max(), pb.max())
    if low >= high:
        raise ValueError("the curves share no range")
    return (10 ** ((_area(pb, rb, low, high) - _area(pa, ra, low, high)) / (high - low)) - 1) * 100


def bd_psnr(reference, test) -> float:
    """Mean PSNR gain in dB over the common range of log rates; NaN where there is none."""
    try:
        (ra, pa), (rb, pb) = _points(reference), _points(test)
    except ValueError:
        return math.nan
    low, high = max(ra.min(), rb.min()), min(ra.max(), rb.max())
    return (_area(rb, pb, low, high) - _area(ra, pa, low, high)) / (high - low) if low < high else math.nan


def bd_deltas(points: DataFrame, by: str, curve: str, reference: str) -> DataFrame:
    """by, curve, bd_rate, bd_psnr of every other curve of a group against the reference. points: by, curve, rate, psnr.

    A curve is a handful of points, so a group fits one task.
    """
    kind = dict(points.dtypes)[by]

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        curves = {c: list(zip(g["rate"], g["psnr"], strict=True)) for c, g in pdf.groupby(curve)}
        base = curves.pop(reference, [])
        rows = []
        for c, pts in sorted(curves.items()):
            try:
                rate = bd_rate(base, pts)
            except ValueError:
                rate = math.nan
            rows.append((key[0], c, rate, bd_psnr(base, pts)))
        return pd.DataFrame(rows, columns=[by, curve, "bd_rate", "bd_psnr"])

    return points.groupBy(by).applyInPandas(run, f"`{by}` {kind}, `{curve}` string, bd_rate double, bd_psnr double")


#: Pixels whose differences are taken at a time.
_PIXELS = 1 << 18


def sampled_differences(df: DataFrame, a: str, b: str, width: int, block: int = 64) -> DataFrame:
    """Adds average, zeros and samples: over every second inner block of two planes (as on a checkerboard, without the blocks at
    the border) the mean sum of absolute differences (whole), how many blocks are equal, and how many there are.

    a, b: binary planes of one length, rows of `width` pixels, of which whole ones count. average and zeros are null where no
    block is sampled or the lengths differ. A batch is one array operation over the pixels of all its rows.
    """
    schema = StructType([*df.schema.fields, *StructType.fromDDL("average bigint, zeros bigint, samples bigint").fields])
    across = -(-width // block)

    def part(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        heights = sizes // width
        down = -(-heights // block)
        r, c = place // width // block, place % width // block
        inner = (r > 0) & (c > 0) & (r < down[row] - 1) & (c < across - 1) & (r % 2 == c % 2)
        inner &= ((c + 1) * block <= width) & ((r + 1) * block <= heights[row])
        first = np.concatenate([[0], np.cumsum(down * across)])
        ids = (first[row] + r * across + c)[inner]
        sums = np.bincount(ids, np.abs(x[inner].astype(np.int16) - y[inner]), minlength=first[-1])
        there = np.bincount(ids, minlength=first[-1]) > 0
        of = np.repeat(np.arange(len(sizes)), down * across)
        count = lambda w: np.bincount(of, w, minlength=len(sizes)).astype(np.int64)
        return count(sums * there), count(there & (sums == 0)), count(there)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            planes = [batch.column(c).to_pylist() for c in (a, b)]
            even = [p is not None and q is not None and len(p) == len(q) for p, q in zip(*planes, strict=True)]
            totals: list[np.ndarray] = []
            start = 0
            while start < batch.num_rows:
                stop, held = start, 0
                while stop < batch.num_rows and (stop == start or held < _PIXELS):
                    held += len(planes[0][stop]) if even[stop] else 0
                    stop += 1
                x, y = (np.frombuffer(b"".join(p[i] for i in range(start, stop) if even[i]), np.uint8) for p in planes)
                sizes = np.array([len(planes[0][i]) if even[i] else 0 for i in range(start, stop)], np.int64)
                totals.append(np.stack(part(x, y, sizes)))
                start = stop
            sums, zeros, samples = np.concatenate(totals, axis=1)
            none = samples == 0
            made = [pa.array(sums // np.maximum(samples, 1), mask=none), pa.array(zeros, mask=none), pa.array(samples)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return df.mapInArrow(run, schema)
