"""Ordered folds whose state does not reduce to windows: drop automata and controllers.

A stream is read in order by one task (Spark sorts it on the way, spilling as needed) and
only its state is held, never the stream: mapInArrow over rows that are partitioned by
stream and sorted within partitions. States end and begin where the stream changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .aggregates import order_statistics


def ordered_fold(df: DataFrame, by: str, order: list[str], inputs: list[str], start: Callable[[], Any], step: Callable[..., tuple], outputs: str) -> DataFrame:
    """Adds `outputs` (a DDL list) to each row: step(state, *inputs) returns their values and may change state. A null key is
    a stream of its own. Other columns pass through as they are."""
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), outputs])
    added = df.sparkSession.createDataFrame([], outputs).schema
    names = [*df.columns, *added.names]
    kinds = list(to_arrow_schema(added))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, begun = None, None, False
        for batch in batches:
            made: list[list] = [[] for _ in kinds]
            keys = batch.column(by).to_pylist()
            for now, *values in zip(keys, *(batch.column(c).to_pylist() for c in inputs), strict=True):
                if not begun or now != key:
                    key, state, begun = now, start(), True
                for column, value in zip(made, step(state, *values), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, f.type) for c, f in zip(made, kinds, strict=True))], names=names)

    return df.repartition(F.col(by)).sortWithinPartitions(by, *order).mapInArrow(run, schema)


@dataclass
class Bucket:
    """Water-mark drop automaton over a leaky bucket."""

    level: float
    factor: int = 0
    count: int = 0


def drop_automaton(df: DataFrame, by: str, order: list[str], bits: str, credit: float, cap: float, optimal: float, water_mark: int) -> DataFrame:
    """Adds level (after the row) and dropped.

    Each row is credited, up to the cap. Without a water mark nothing is dropped. A negative level drops the row. Below the mark
    (water_mark percent of optimal, a whole number) a decimation factor counts up from 1,
    above it counts down; with a factor, each kept row is followed by so many dropped
    ones. A dropped row is not debited.
    """
    mark = int(water_mark * optimal // 100)

    def step(s: Bucket, size) -> tuple[float, bool]:
        s.level = min(s.level + credit, cap)
        drop = water_mark > 0 and s.level < 0
        if not drop and water_mark > 0:
            if s.level > mark and s.factor > 0:
                s.factor -= 1
            elif s.level <= mark and s.factor == 0:
                s.factor = 1
            if s.factor > 0:
                drop = s.count > 0
                s.count = s.count - 1 if drop else s.factor
            else:
                s.count = 0
        if not drop:
            s.level -= size
        return s.level, drop

    return ordered_fold(df, by, order, [bits], lambda: Bucket(optimal), step, "level double, dropped boolean")


def decimation(df: DataFrame, by: str, order: list[str], bits: str, key: str, credit: int, cap: int, optimal: int, water_mark: int, allowed: bool = True) -> DataFrame:
    """Adds level (after the row), factor and dropped, in whole numbers.

    The mark is water_mark percent of optimal. Before each row the factor (0 to 3) falls by one above the mark; above two
    thirds of it a factor that is left becomes 1, below an eighth a factor of 2 or 3 becomes 3, below a quarter 1 or 2 becomes 2,
    below two thirds 0 or 1 becomes 1. With a factor, each kept row is followed by so many dropped ones; rows with a true
    `key` are never dropped. Each row is credited and a kept one debited, up to the cap.
    """
    mark = optimal * water_mark // 100 if water_mark > 0 else 0
    high, half, low = mark * 2 // 3, mark // 4, mark // 8

    def step(s: Bucket, size, is_key) -> tuple[int, int, bool]:
        if allowed:
            if s.level > mark and s.factor > 0:
                s.factor -= 1
            if s.level > high and s.factor > 0:
                s.factor = 1
            elif s.level < low and s.factor in (2, 3):
                s.factor = 3
            elif s.level < half and s.factor in (1, 2):
                s.factor = 2
            elif s.level < high and s.factor in (0, 1):
                s.factor = 1
        drop = False
        if not allowed or s.factor == 0:
            s.count = 0
        else:
            drop = not is_key and s.count > 0
            s.count = s.count - 1 if drop else s.factor
        s.level = min(s.level + credit - (0 if drop else int(size)), cap)
        return s.level, s.factor, drop

    return ordered_fold(df, by, order, [bits, key], lambda: Bucket(optimal), step, "level bigint, factor int, dropped boolean")


@dataclass
class Cap:
    active: int
    requested: int
    slow: int = 0
    fast: int = 0


def cap_controller(df: DataFrame, by: str, order: list[str], elapsed: str, interval: str, requested: str, lower_after: int = 3, raise_after: int = 30, least: int = 1) -> DataFrame:
    """Adds cap: a streak of overruns (elapsed > 2 * interval) lowers it, a streak of fast rows (elapsed < 3/4 of the interval)
    raises it again up to the request; other rows end both streaks, and a changed request takes effect at once."""

    def step(s: Cap, took, due, want) -> tuple[int]:
        if s.requested != want:
            s.active, s.requested, s.slow, s.fast = want, want, 0, 0
        s.slow = s.slow + 1 if took > 2 * due > 0 and s.active > least else 0
        s.fast = s.fast + 1 if 4 * took < 3 * due and s.active < s.requested else 0
        if s.slow >= lower_after:
            s.active, s.slow = s.active - 1, 0
        if s.fast >= raise_after:
            s.active, s.fast = s.active + 1, 0
        return (s.active,)

    return ordered_fold(df, by, order, [elapsed, interval, requested], lambda: Cap(-1, -1), step, "cap bigint")


def repair_cap(df: DataFrame, by: str, order: list[str], repair: str, progress: str, cap: int, lower_after: int) -> DataFrame:
    """Adds cap: so many repairs without progress between them lower it by one, down to 1, and begin anew."""

    def step(s: dict, asked, moved) -> tuple[int]:
        s["streak"] = s["streak"] + 1 if asked else 0 if moved else s["streak"]
        if s["streak"] >= lower_after and s["cap"] > 1:
            s["cap"], s["streak"] = s["cap"] - 1, 0
        return (s["cap"],)

    return ordered_fold(df, by, order, [repair, progress], lambda: {"cap": cap, "streak": 0}, step, "cap bigint")


def skin_smoothing(df: DataFrame, key: str, rows: str, cols: str, cells: str) -> DataFrame:
    """key, smoothed: inner cells of a 0/1 map in raster order, each seeing the earlier changes. A set cell without
    set neighbours is cleared, a clear one with eight set neighbours is set; maps below 3 x 3 stay."""

    def one(n: int, m: int, flat) -> list[int]:
        import numpy as np

        grid = np.asarray(flat, np.int64)[: n * m].reshape(n, m).copy()
        for i in range(1, n - 1):
            for j in range(1, m - 1):
                around = int((grid[i - 1 : i + 2, j - 1 : j + 2] != 0).sum())
                if around == 1 and grid[i, j]:
                    grid[i, j] = 0
                elif around == 8 and not grid[i, j]:
                    grid[i, j] = 1
        return grid.ravel().tolist()

    @F.udf("array<int>", useArrow=True)
    def smooth(n, m, flat):
        return one(n, m, flat) if n >= 3 and m >= 3 and len(flat) >= n * m else list(flat)

    return df.select(key, smooth(rows, cols, cells).alias("smoothed"))


def rolling_average(df: DataFrame, by: str, order: list[str], value: str, weight: int = 3, shift: int = 2) -> DataFrame:
    """Adds rolling: (weight * before + value + half) >> shift in whole numbers, from the first value."""
    half = 1 << (shift - 1)

    def step(s: dict, v) -> tuple[int]:
        v = int(v)
        s["x"] = (weight * s["x"] + v + half) >> shift if "x" in s else v
        return (s["x"],)

    return ordered_fold(df, by, order, [value], dict, step, "rolling bigint")


def noise_average(levels: DataFrame, by: str, order: list[str], level: str, start: int = 0) -> DataFrame:
    """Adds noise: (3 * before + 40 * bin) >> 2 in whole numbers, from `start`; bins are those of aggregates.noise_level. A frame
    without one (null) leaves it as it is."""

    def step(s: dict, found) -> tuple[int]:
        if found is not None:
            s["v"] = (3 * s["v"] + 40 * int(found)) >> 2
        return (s["v"],)

    return ordered_fold(levels, by, order, [level], lambda: {"v": start}, step, "noise bigint")


@dataclass
class Sequencer:
    picture: int = 0
    base: int = -1
    signature: Any = field(default=None)


def picture_ids(df: DataFrame, by: str, order: list[str], layer: str, dropped: str, signature: str, wrap: int = 1 << 15) -> DataFrame:
    """Adds picture_id and tl0: a sent frame or a newly notified drop takes an id; the same drop notified again takes none (null)."""

    def step(s: Sequencer, at, gone, mark) -> tuple[int | None, int]:
        if gone:
            if mark == s.signature:
                return None, max(s.base, 0) % 256
            s.signature = mark
        else:
            s.signature = None
            if at == 0:
                s.base += 1
        used, s.picture = s.picture, (s.picture + 1) % wrap
        return used, max(s.base, 0) % 256

    return ordered_fold(df, by, order, [layer, dropped, signature], Sequencer, step, "picture_id bigint, tl0 bigint")


def look_ahead(df: DataFrame, by: str, order: list[str], flush: str, depth: int) -> DataFrame:
    """Adds frame (the place, from 1, of the frame that a call lets go; null for none) and drained. A call is a frame or, where `flush`
    is true, a drain of one. A frame's call lets the oldest one go when the queue then holds `depth`."""

    def step(s: dict, drain) -> tuple[int | None, bool]:
        if not drain:
            s["held"] += 1
        if not s["held"] or not (drain or s["held"] == depth):
            return None, False
        s["held"], s["gone"] = s["held"] - 1, s["gone"] + 1
        return s["gone"], bool(drain)

    return ordered_fold(df, by, order, [flush], lambda: {"held": 0, "gone": 0}, step, "frame bigint, drained boolean")


@dataclass
class PacketizerState:
    """Picture ids of a sender, the latch that asks for a recovery key, and the drop that was told last.

    Calls: packetize and size (of a frame), unsent (a packetized frame was withheld), encoded_unsent (one that was not packetized).
    A dropped frame takes an id on either of the first two, once for each signature; it asks for a key unless it is of the top of
    several layers. While a key is asked for, other frames are refused and nothing changes. A failed frame asks for a key (unless it only
    lacked room); a packetized one takes its id and settles the latch; a size changes nothing else. Withholding asks for a key, and takes an
    id where the frame had none yet.
    """

    COLUMNS = ("call", "dropped", "key", "layer", "layers", "signature", "error")

    picture: int = 0
    pending: bool = False
    signature: str | None = None
    key_needed: bool = False

    def advance(self, wrap: int = 1 << 15) -> int:
        used, self.picture = self.picture, (self.picture + 1) % wrap
        return used

    def step(self, call: str, dropped: bool, key: bool, layer: int, layers: int, signature: str | None, error: str | None) -> tuple[str, int | None, bool]:
        """(outcome, id that the call has taken, whether a key is asked for now)."""
        if call in ("unsent", "encoded_unsent"):
            self.pending, self.key_needed = False, True
            return "withheld", self.advance() if call == "encoded_unsent" else None, True
        if dropped:
            if self.pending and self.signature == signature:
                return "dropped", None, self.key_needed
            self.pending, self.signature = True, signature
            self.key_needed = self.key_needed or layers <= 1 or layer < layers - 1
            return "dropped", self.advance(), self.key_needed
        if self.key_needed and not (key and layer == 0):
            return "refused", None, True
        if call == "size":
            self.pending = False
        if error:
            self.key_needed = self.key_needed or error != "small"
            return error, None, self.key_needed
        if call == "size":
            return "sized", None, self.key_needed
        self.pending, self.key_needed = False, False
        return "sent", self.advance(), False


def packetizer(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Adds outcome, picture_id (that the call has taken) and key_needed (after it) to calls: call, dropped, key, layer, layers, signature, error."""
    return ordered_fold(df, by, order, list(PacketizerState.COLUMNS), PacketizerState, lambda s, *x: s.step(*x), "outcome string, picture_id int, key_needed boolean")


def kmeans_1d(values, k: int = 8, rounds: int = 10):
    """Lloyd's iterations in one dimension: quantile starts, exactly `rounds` rounds, empty clusters keep their centre."""
    import numpy as np

    x = np.sort(np.asarray(values, float))
    if not len(x):
        return np.zeros(0)
    centers = x[(np.arange(k) * 2 + 1) * len(x) // (2 * k)]
    for _ in range(rounds):
        label = np.abs(x[:, None] - centers).argmin(axis=1)
        centers = np.array([x[label == i].mean() if (label == i).any() else centers[i] for i in range(k)])
    return centers


def kmeans_1d_distributed(df: DataFrame, value: str, k: int = 8, rounds: int = 10) -> DataFrame:
    """The same over a whole column: each round is one aggregation of k sums, so only k numbers come to the driver."""
    spark = df.sparkSession
    v = df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL").persist()
    starts = order_statistics(v, [], "v", {f"c{i}": F.floor((F.col("total") * (2 * i + 1)) / (2 * k)) + 1 for i in range(k)}).first()
    centers = [] if starts is None else [starts[f"c{i}"] for i in range(k)]
    for _ in range(rounds):
        if not centers:
            break
        near = F.array_min(F.transform(F.array(*map(F.lit, centers)), lambda c, i: F.struct(F.abs(F.col("v") - c), i.alias("i"))))["i"]
        sums = {r["c"]: r["m"] for r in v.groupBy(near.alias("c")).agg(F.avg("v").alias("m")).collect()}
        centers = [sums.get(i, c) for i, c in enumerate(centers)]
    v.unpersist()
    return spark.createDataFrame([(i, float(c)) for i, c in enumerate(centers)], "cluster int, center double")
