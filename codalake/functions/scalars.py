"""Arithmetic of rate control, geometry and clocks, as SQL expressions on whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _saturated(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(LOW).cast("decimal(38,0)")), F.lit(HIGH).cast("decimal(38,0)")).cast("bigint")


def saturating_add(a: Column, b: Column) -> Column:
    """Bounds are told before adding: a sum that overflows would cost an exception a row."""
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.when((b > 0) & (a > HIGH - b), F.lit(HIGH)).when((b < 0) & (a < F.lit(LOW) - b), F.lit(LOW)).otherwise(a + b)


def saturating_sub(a: Column, b: Column) -> Column:
    a, b = a.cast("bigint"), b.cast("bigint")
    return F.when((b > 0) & (a < F.lit(LOW) + b), F.lit(LOW)).when((b < 0) & (a > F.lit(HIGH) + b), F.lit(HIGH)).otherwise(a - b)


def percent_of(value: Column, percent: Column) -> Column:
    """value * percent / 100, truncated toward zero and saturated."""
    product = value.cast("decimal(19,0)") * percent.cast("decimal(18,0)")
    whole = F.floor(F.abs(product) / 100)
    return _saturated((F.when(product < 0, -whole).otherwise(whole)).cast("decimal(38,0)"))


def _div(a: Column, b: Column) -> Column:
    """Truncated toward zero."""
    return F.call_function("div", a, b)


def checked_mul(a: Column, b: Column) -> Column:
    """Null where the product does not fit, which is told by division beforehand."""
    a, b = a.cast("bigint"), b.cast("bigint")
    high, low = _div(F.lit(HIGH), b), _div(F.lit(LOW), b)
    fits = F.when(b > 0, (a <= high) & (a >= low)).when(b < -1, (a >= high) & (a <= low)).otherwise((b == 0) | (a > LOW))
    return F.when(fits, a * b)


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(value, low), high)


def macroblock_rows(height: Column) -> Column:
    return F.shiftright(height + 15, 4)


def align(value: Column, to: Column) -> Column:
    return F.floor((value + to - 1) / to) * to


def chroma(width: Column, height: Column) -> Column:
    """Chroma width and height of 4:2:0, and the bytes of all three planes."""
    w, h = F.floor((width + 1) / 2), F.floor((height + 1) / 2)
    return F.struct(w.alias("width"), h.alias("height"), (width * height + 2 * w * h).alias("bytes"))


def size_bits(size: Column) -> Column:
    """8 * size saturated; not positive sizes have none."""
    return F.when(size <= 0, F.lit(0).cast("bigint")).otherwise(_saturated(_wide(size) * 8))


def bits_per_frame(bandwidth: Column, num: Column, den: Column, duration: Column) -> Column:
    """Bandwidth times frame duration, rounded to the nearest bit; 0 unless both are positive."""
    product, under = checked_mul(checked_mul(bandwidth, num), duration), den.cast("bigint")
    half = _div(under, F.lit(2).cast("bigint"))
    whole = F.when((product > 0) & (under > 0), _div(product + half, under)).otherwise(0).cast("bigint")
    return F.when(product <= F.lit(HIGH) - F.greatest(half, F.lit(0)), whole).otherwise(_wide_bits(bandwidth, num, den, duration))


def _wide_bits(bandwidth: Column, num: Column, den: Column, duration: Column) -> Column:
    """The same for products beyond 64 bits."""
    over, under = _wide(bandwidth) * num * duration, _wide(den)
    return F.when((over > 0) & (under > 0), F.floor((over + F.floor(under / 2)) / under)).otherwise(0).cast("bigint")


def pct_delta(got: Column, want: Column) -> Column:
    return F.abs(got - want) * 100.0 / F.greatest(F.abs(want), F.lit(1))


def gcd(a: int, b: int) -> int:
    while b:
        a, b = b, a % b
    return abs(a)


def lcm(a: int, b: int) -> int:
    """Of two positive numbers; 0 otherwise."""
    return a // gcd(a, b) * b if a > 0 and b > 0 else 0


def clock_ticks(frame: Column, fps: Column) -> Column:
    """Frame number to ticks of the 90 kHz clock."""
    return F.when(fps > 0, F.floor(frame * 90_000 / fps)).otherwise(0).cast("bigint")


def frame_of_elapsed(elapsed_ns: Column, fps: int) -> Column:
    """The frame that is due after so many ns: whole intervals (truncated to ns) less one."""
    return F.floor(elapsed_ns / (1_000_000_000 // fps)) - 1


def is_overrun(elapsed: Column, interval: Column) -> Column:
    return (interval > 0) & (elapsed > 2 * interval)


def post_encode_drop(level: Column, credit: Column, bits: Column, intra: Column, shown: Column, q: Column, worst_q: Column) -> Column:
    """Whether a shown inter frame below the worst quality would leave the buffer negative."""
    return ~intra & shown & (q < worst_q) & (saturating_sub(saturating_add(level, credit), bits) < 0)


# Shares of the total bitrate by number of layers, cumulative, in percent.
LAYER_SHARES = {1: [100], 2: [60, 100], 3: [40, 60, 100]}


def layer_bitrates(total: Column, layers: int) -> Column:
    """Default cumulative bitrates of the temporal layers; there is none for more than three."""
    if layers not in LAYER_SHARES:
        raise ValueError("no default for so many layers")
    return F.array(*[F.floor(total * p / 100).cast("bigint") for p in LAYER_SHARES[layers]])


def valid_layer_bitrates(rates: Column, total: Column) -> Column:
    """Positive, strictly increasing, and ending at the total."""
    rises = F.forall(F.transform(rates, lambda x, i: (x > 0) & ((i == 0) | (x > F.coalesce(F.get(rates, i - 1), F.lit(0))))), lambda ok: ok)
    return rises & (F.size(rates) > 0) & (F.element_at(rates, -1) == total)


def layer_differences(cumulative: Column) -> Column:
    """Each layer's own bitrate from the cumulative ones."""
    return F.transform(cumulative, lambda x, i: x - F.when(i > 0, F.get(cumulative, i - 1)).otherwise(0))


def split_bitrate(total: int, percents: list[int]) -> list[int]:
    """Whole shares; the last layer gets what rounding leaves."""
    parts = [total * p // 100 for p in percents]
    return [*parts[:-1], total - sum(parts[:-1])]


def clamp_to_level(kbps: Column, level_kbps: Column) -> Column:
    """At most 80 % of the level's average bitrate; without a level or bitrate it stays."""
    cap = F.floor(level_kbps * 8 / 10)
    return F.when((kbps > 0) & (cap > 0), F.least(kbps, cap)).otherwise(kbps).cast("bigint")


# Temporal layering modes: layer of each frame of the period, and by how much each layer divides the frame rate.
TEMPORAL_PATTERNS = {
    "one_layer": ([0], [1]),
    "two_layers": ([0, 1], [2, 1]),
    "two_layers_three_frame": ([0, 1, 1], [3, 1]),
    "three_layers_six_frame": ([0, 2, 2, 1, 2, 2], [6, 3, 1]),
    "three_layers_no_inter_layer_prediction": ([0, 2, 1, 2], [4, 2, 1]),
    "three_layers_layer_one_prediction": ([0, 2, 1, 2], [4, 2, 1]),
    "three_layers": ([0, 2, 1, 2], [4, 2, 1]),
    "five_layers": ([0, 4, 3, 4, 2, 4, 3, 4, 1, 4, 3, 4, 2, 4, 3, 4], [16, 8, 4, 2, 1]),
    "two_layers_with_sync": ([0, 1], [2, 1]),
    "three_layers_with_sync": ([0, 2, 1, 2], [4, 2, 1]),
    "three_layers_alt_ref_with_sync": ([0, 2, 1, 2], [4, 2, 1]),
    "three_layers_one_reference": ([0, 2, 1, 2], [4, 2, 1]),
    "three_layers_no_sync": ([0, 2, 1, 2], [4, 2, 1]),
}


def temporal_patterns(spark: SparkSession) -> DataFrame:
    """mode, idx, layer, decimator: the patterns as a dimension table."""
    rows = [(mode, i, layer, decimators[layer]) for mode, (layers, decimators) in TEMPORAL_PATTERNS.items() for i, layer in enumerate(layers)]
    return spark.createDataFrame(rows, "mode string, idx int, layer int, decimator int")


def clamp_frame_rate(fps: Column) -> Column:
    """A rate below 0.1 is none, and counts as 30."""
    return F.when(fps < 0.1, F.lit(30.0)).otherwise(fps)


def greatest_divisor(a: Column, b: Column) -> Column:
    """Greatest common divisor of two whole numbers that are not negative, for all rows of a batch at once; null where one is null."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        none = np.asarray(pc.or_(x.is_null(), y.is_null()))
        p, q = (np.asarray(v.fill_null(0)) for v in (x, y))
        return pa.array(np.gcd(p, q), pa.int64(), mask=none)

    return run(a.cast("bigint"), b.cast("bigint"))
