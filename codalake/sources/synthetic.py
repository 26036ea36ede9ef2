"""Deterministic synthetic frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def frame(width: int, height: int, index: int) -> tuple[bytes, bytes, bytes]:
    """Luma 32 + ((3 row + 5 column + 7 index) & 191), flat chroma that moves with the index."""
    r, c = np.ogrid[:height, :width]
    y = (32 + ((3 * r + 5 * c + 7 * index) & 191)).astype(np.uint8).tobytes()
    n = ((width + 1) // 2) * ((height + 1) // 2)
    return y, bytes([96 + index % 64]) * n, bytes([160 - index % 64]) * n


def _triangle(x: np.ndarray, period: int) -> np.ndarray:
    """A triangle wave from 0 to 255 in whole numbers."""
    half, at = period // 2, x % period
    return np.where(at < half, at, period - at) * 255 // half


def panning(width: int, height: int, index: int) -> tuple[bytes, bytes, bytes]:
    """Smooth waves that move by two columns and one row a frame."""
    return tuple(p.tobytes() for p in panning_many(width, height, np.array([index], np.int64)))


def panning_many(width: int, height: int, indexes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many frames at once: a row of pixels for each."""
    k = indexes[:, None, None]
    y, x = np.ogrid[:height, :width]
    x, y = x + 2 * k, y + k
    luma = 64 + _triangle(x + y, 256) // 4 + _triangle(x, 64) // 4 + _triangle(y, 64) // 4
    v, u = np.ogrid[: (height + 1) // 2, : (width + 1) // 2]
    chroma = lambda at: 128 + np.trunc((_triangle(at, 128) - 128) / 8).astype(np.int64)
    small = np.zeros((1, (height + 1) // 2, (width + 1) // 2), np.int64)
    return tuple(np.clip(p, 0, 255).astype(np.uint8).reshape(len(indexes), -1) for p in (luma, chroma(2 * u + 2 * k) + small, chroma(2 * v + k) + small))


def checker(width: int, height: int, index: int) -> tuple[bytes, bytes, bytes]:
    """Squares of 16 pixels that move by a column a frame, and by a row every second one."""

    def odd(step: int, rows: int, columns: int) -> np.ndarray:
        r, c = np.ogrid[:rows, :columns]
        return ((step * c + index) // 16 ^ (step * r + index // 2) // 16) & 1

    cells = odd(2, (height + 1) // 2, (width + 1) // 2)
    planes = np.where(odd(1, height, width), 208, 48), np.where(cells, 144, 112), np.where(cells, 112, 144)
    return tuple(p.astype(np.uint8).tobytes() for p in planes)


#: What frames_of() makes, by kind.
KINDS = {"ramp": frame, "panning": panning, "checker": checker}
#: Those that are made for many rows at once, and the pixels of a time.
MANY, _PIXELS = {"panning": panning_many}, 1 << 20


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary array of rows of equal length."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def frames_of(rows: DataFrame, index: str, width: int, height: int, kind: str = "ramp") -> DataFrame:
    """rows with the planes y, u, v of the frame of that kind that their index numbers."""
    make, many = KINDS[kind], MANY.get(kind)
    step = max(1, _PIXELS // max(1, width * height))
    schema = StructType([*rows.schema.fields, *StructType.fromDDL("y binary, u binary, v binary").fields])

    def planes_of(batch: pa.RecordBatch) -> list[pa.Array]:
        if many and not batch.column(index).null_count:
            return [_binary(p) for p in many(width, height, batch.column(index).cast(pa.int64()).to_numpy(zero_copy_only=False))]
        planes = [make(width, height, int(i)) for i in batch.column(index).to_pylist()]
        return [pa.array([p[k] for p in planes], pa.binary()) for k in range(3)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                yield pa.RecordBatch.from_arrays([*batch.columns, *planes_of(batch)], names=schema.names)

    return rows.mapInArrow(run, schema)


def synthetic_frames(spark: SparkSession, width: int, height: int, count: int) -> DataFrame:
    """idx, width, height, y, u, v of the first frames."""
    rows = spark.range(count).select(F.col("id").cast("int").alias("idx"), F.lit(width).alias("width"), F.lit(height).alias("height"))
    return frames_of(rows, "idx", width, height)
