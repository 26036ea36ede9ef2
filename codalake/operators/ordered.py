"""Operations on rows in order: neighbours, runs, schedules and clamped running sums.

All of them are windows over a stream's key, so streams are independent and a stream's
rows are read once in order; none gathers a stream in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _forward(by: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)


def next_valid(df: DataFrame, by: list[str], order: list[str], value: Column, valid: Column, name: str, default: Column) -> DataFrame:
    """The value of the first later row that is valid, or a default."""
    return df.withColumn(name, F.coalesce(F.first(F.when(valid, value), ignorenulls=True).over(_forward(by, order)), default))


def carry_last(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value up to and with this row: a section header carried down."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def streaks(df: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """One row per run of equal states: by, state, run (its number), length."""
    w = Window.partitionBy(*by).orderBy(*order)
    begins = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    runs = df.withColumn("__b", begins).withColumn("run", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run", state).agg(F.count(F.lit(1)).alias("length"))


def running_streak(df: DataFrame, by: list[str], order: list[str], hit: Column, name: str) -> DataFrame:
    """How many rows in a row, up to this one, are hits."""
    w = Window.partitionBy(*by).orderBy(*order)
    at = df.withColumns({"__rn": F.row_number().over(w), "__hit": hit})
    last_miss = F.max(F.when(~F.coalesce(F.col("__hit"), F.lit(False)), F.col("__rn"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn(name, F.col("__rn") - F.coalesce(last_miss, F.lit(0))).drop("__rn", "__hit")


def forward_rows(df: DataFrame, by: list[str], order: list[str], value: Column, count: int, name: str) -> DataFrame:
    """The values of this and the next count - 1 rows, fewer at the end."""
    return df.withColumn(name, F.collect_list(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, count - 1)))


def forward_sum(df: DataFrame, by: list[str], order: list[str], value: Column, count: int) -> DataFrame:
    """Adds n and total of this and the next count - 1 rows, fewer at the end."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, count - 1)
    return df.withColumns({"n": F.count(value).over(w), "total": F.sum(value).over(w)})


def all_next_at_least(df: DataFrame, by: list[str], order: list[str], value: Column, k: int, least: float, name: str) -> DataFrame:
    """Whether the next k rows are all there and at least so large."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, k)
    return df.withColumn(name, (F.count(value).over(w) == k) & (F.min(value).over(w) >= least))


def remaining_total(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The sum of this row and all later ones: the total less what has gone before."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(name, F.sum(value).over(w))


def group_number(df: DataFrame, by: list[str], order: list[str], starts: Column, name: str) -> DataFrame:
    """Numbers groups that begin at the marked rows (key-frame groups); rows before the first are in group 0."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(w))


def periodic_schedule(df: DataFrame, by: list[str], order: list[str], layers: list[int], wrap: int = 256) -> DataFrame:
    """layer from a repeating pattern, and tl0: how many base-layer rows so far, modulo wrap."""
    w = Window.partitionBy(*by).orderBy(*order)
    place = (F.row_number().over(w) - 1) % len(layers)
    pattern = F.array(*map(F.lit, layers))
    out = df.withColumn("layer", F.get(pattern, place))
    return out.withColumn("tl0", F.sum((F.col("layer") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) % wrap)


def leaky_bucket(df: DataFrame, by: list[str], order: list[str], credit: Column, debit: Column, start: float, cap: float, name: str = "level") -> DataFrame:
    """level = min(level before + credit, cap) - debit, from `start`.

    With P the running sum of credit - debit, that is P + min(start, the least of cap - debit - P so far): two
    windows over the same sort instead of a fold over a gathered list.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = df.withColumn("__debit", debit).withColumn("__sum", F.sum(credit - debit).over(w))
    room = F.min(F.lit(cap) - F.col("__debit") - F.col("__sum")).over(w)
    return at.withColumn(name, F.col("__sum") + F.least(F.lit(start), room)).drop("__debit", "__sum")


def monotone_counter(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Forces a counter to increase strictly: max(value, previous result + 1)."""
    w = Window.partitionBy(*by).orderBy(*order)
    at = df.withColumn("__rn", F.row_number().over(w))
    lead = F.max(value - F.col("__rn")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn(name, lead + F.col("__rn")).drop("__rn")


def delayed(df: DataFrame, by: list[str], order: list[str], depth: int, name: str) -> DataFrame:
    """Bounded look-ahead queue: the row at which each one leaves (depth rows later; null: only the final flush)."""
    return df.withColumn(name, F.lead(F.struct(*order), depth).over(Window.partitionBy(*by).orderBy(*order)))


def rate_from_timestamps(df: DataFrame, by: list[str], order: list[str], pts: Column, ticks_per_second: int, name: str) -> DataFrame:
    """Frames a second from the distance to the previous timestamp; null at the start and for no advance."""
    gap = pts - F.lag(pts).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.when(gap > 0, F.lit(float(ticks_per_second)) / gap))


def tile_schedule(df: DataFrame, by: str, order: list[str], size: str, workers: int) -> DataFrame:
    """Adds place, the position (from 0) at which a tile of its frame is decoded: by falling size, ties in order. With a worker
    for each tile the largest goes last; with fewer, every second tile from the front is swapped with one from the back."""
    frame = Window.partitionBy(by)
    at = F.row_number().over(frame.orderBy(F.desc(size), *order)) - 1
    given = F.row_number().over(frame.orderBy(*order)) - 1
    n = F.count(F.lit(1)).over(frame)
    across = n - 2 - at
    swapped = ((at % 2 == 0) & (at < across)) | ((across % 2 == 0) & (across >= 0) & (across < at))
    place = F.when(n <= workers, (at + n - 1) % n).when(swapped, across).otherwise(at)
    return df.withColumn("place", (place if workers > 1 else given).cast("bigint"))
