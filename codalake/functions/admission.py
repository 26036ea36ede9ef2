"""Which frames and settings are accepted, with the reason of a refusal, as SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INVALID, REJECTED = "invalid", "rejected"


def frame_admission(df: DataFrame, by: list[str], order: list[str], key: str, width: str, height: str, profile: str, max_width: int = 0, max_height: int = 0, fixed_size: bool = False) -> DataFrame:
    """Adds refusal: 'invalid' (unknown profile, or a key frame without a size), 'rejected' (larger than a limit that is set, or
    with fixed_size another size than the stream's first accepted key frame), or null. Inter frames carry no size to check."""
    w, h = F.col(width), F.col(height)
    bad = ~F.col(profile).between(0, 7) | (F.col(key) & ((w <= 0) | (h <= 0)))
    large = F.lit(False)
    if max_width > 0:
        large = large | (w > max_width)
    if max_height > 0:
        large = large | (h > max_height)
    sized = F.col(key) & ~bad & ~large
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # A refused key frame leaves the size as it is, so the first accepted one decides for the whole stream.
    first = F.first(F.when(sized, F.struct(w.alias("w"), h.alias("h"))), ignorenulls=True).over(before)
    changed = first.isNotNull() & ((first["w"] != w) | (first["h"] != h)) if fixed_size else F.lit(False)
    return df.withColumn("refusal", F.when(bad, INVALID).when(F.col(key) & (large | changed), REJECTED))


# Fixed value: most percent of undershoot and overshoot, and the largest public quantizer.
MOST_PERCENT, MOST_QUANTIZER = 100, 63


def rate_settings_problem(s: Column) -> Column:
    """What is wrong first with rate-control settings: 'config', 'bitrate', 'quantizer', or null.

    s: a struct of mode (vbr, cbr, cq or q), target, least, most (kbps; 0 for none), undershoot, overshoot (percent),
    intra, golden_boost, buffer, buffer_initial, buffer_optimal, drop_mark, drops (boolean), min_q, max_q, cq_level.
    """
    rates = (
        (s["target"] <= 0) | (s["least"] < 0) | (s["most"] < 0)
        | ((s["least"] > 0) & (s["most"] > 0) & (s["least"] > s["most"]))
        | (s["target"] < s["least"]) | ((s["most"] > 0) & (s["target"] > s["most"]))
    )
    percent = lambda c: ~s[c].between(0, MOST_PERCENT)
    negative = (s["intra"] < 0) | (s["golden_boost"] < 0) | (s["buffer"] < 0) | (s["buffer_initial"] < 0) | (s["buffer_optimal"] < 0) | (s["drop_mark"] < 0)
    only_cbr = (s["mode"] != "cbr") & (s["drops"] | (s["drop_mark"] != 0) | (s["golden_boost"] != 0))
    ranges = ~s["min_q"].between(0, MOST_QUANTIZER) | ~s["max_q"].between(0, MOST_QUANTIZER) | ~s["cq_level"].between(0, MOST_QUANTIZER)
    given = (s["min_q"] != 0) | (s["max_q"] != 0)
    level = (s["cq_level"] != 0) & given & ~s["cq_level"].between(s["min_q"], s["max_q"])
    return (
        F.when(~s["mode"].isin("vbr", "cbr", "cq", "q"), "config")
        .when(rates, "bitrate")
        .when(percent("undershoot") | percent("overshoot") | negative | only_cbr, "config")
        .when(ranges | (given & (s["min_q"] > s["max_q"])) | level, "quantizer")
    )


def filter_window(distance: Column, queued: Column, most: Column, kind: Column, vp9: bool = False) -> Column:
    """How many frames before and after the centre a temporal filter takes: a struct of backward and forward; null without a window.

    kind 1 looks back only, 2 ahead only, 3 both ways, evenly. distance: frames before the centre; queued: in the look-ahead.
    With vp9, a centre at the end of the queue takes frames before it only.
    """
    ahead = queued - distance - 1
    even = F.least(distance, ahead)
    both = F.struct(F.least(even, F.floor(most / 2)).cast("bigint").alias("backward"), F.least(even, F.floor((most - 1) / 2)).cast("bigint").alias("forward"))
    one = lambda back, on: F.struct(F.least(back, most - 1).cast("bigint").alias("backward"), F.least(on, most - 1).cast("bigint").alias("forward"))
    none = F.lit(0).cast("bigint")
    out = F.when(kind == 1, one(distance, none)).when(kind == 2, one(none, ahead))
    if vp9:
        out = out.when((kind == 3) & (ahead == 0), one(distance, none))
    out = out.when(kind == 3, both)
    fits = (distance >= 0) & (ahead >= 0) & (most > (1 if vp9 else 0))
    return F.when(fits, out)
