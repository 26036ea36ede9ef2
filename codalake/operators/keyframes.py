"""Where groups of frames end: scene-cut tests over three frames and a bounded look ahead, and the walk to the next key frame.

Rows are first-pass statistics: pcnt_inter, pcnt_second_ref, pcnt_neutral, pcnt_motion, mvr_abs, mvc_abs, intra_error,
coded_error. Each row looks at a bounded number of rows behind it, so a stream is read once in order and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .walks import bounded_walk

# Least distance of a group, what weighs and bounds the score of a frame, and how many frames a test looks at.
LEAST_GROUP, WEIGHT, MOST_SCORE, LOOK = 4, 1.40, 14.0, 16
STILL = 0.999


def _safe(x: Column) -> Column:
    """A divisor that is never 0."""
    return F.when(x < 0, x - 0.000001).otherwise(x + 0.000001)


def decay_rate() -> Column:
    """How well a frame predicts the next: the least of its inter share, its motion share's decay and its vectors' decay."""
    motion = F.col("pcnt_motion")
    far = lambda c: F.abs(F.col(c) * motion)
    distance = F.sqrt(far("mvr_abs") * far("mvr_abs") + far("mvc_abs") * far("mvc_abs")) / 250.0
    return F.least(F.col("pcnt_inter"), 1.0 - motion / 20.0, F.when(distance > 1.0, 0.0).otherwise(1.0 - distance))


def _gate(last: dict[str, Column], this: dict[str, Column], after: dict[str, Column]) -> Column:
    changed = lambda c: F.abs(last[c] - this[c]) / _safe(this[c]) > 0.40
    weak = (
        (this["pcnt_inter"] - this["pcnt_neutral"] < 0.25)
        & (this["intra_error"] / _safe(this["coded_error"]) < 2.5)
        & (changed("coded_error") | changed("intra_error") | (after["intra_error"] / _safe(after["coded_error"]) > 3.5))
    )
    return (this["pcnt_second_ref"] < 0.10) & (after["pcnt_second_ref"] < 0.10) & ((this["pcnt_inter"] < 0.05) | weak)


def scene_cuts(df: DataFrame, by: list[str], order: list[str], name: str, whole: bool = False) -> DataFrame:
    """Adds whether a row is a candidate for a key frame: a gate over the rows before and behind it, and where it holds a walk
    over the next LOOK rows, whose decayed scores must come to more than 5 before it ends, behind the fourth of them.

    The walk ends at a weak row. Where the stream ends first, `whole` counts all rows seen, otherwise all but the last.
    The first and the last row of a stream are none.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    columns = ["pcnt_inter", "pcnt_second_ref", "pcnt_neutral", "intra_error", "coded_error"]
    this, last, after = ({c: f(F.col(c)) for c in columns} for f in (lambda c: c, lambda c: F.lag(c).over(w), lambda c: F.lead(c).over(w)))
    rows = F.collect_list(F.struct("pcnt_inter", "pcnt_neutral", "intra_error", "coded_error")).over(w.rowsBetween(1, LOOK))
    state = lambda n, boost, old, decay, stop: F.struct(n.alias("n"), boost.alias("boost"), old.alias("old"), decay.alias("decay"), stop.alias("stop"))

    def step(s: Column, x: Column) -> Column:
        score = F.least(F.lit(WEIGHT) * x["intra_error"] / _safe(x["coded_error"]), F.lit(MOST_SCORE))
        decay = s["decay"] * F.when(x["pcnt_inter"] > 0.85, x["pcnt_inter"]).otherwise((0.85 + x["pcnt_inter"]) / 2.0)
        boost = s["boost"] + decay * score
        ends = (
            (x["pcnt_inter"] < 0.05)
            | (score < 1.5)
            | ((x["pcnt_inter"] - x["pcnt_neutral"] < 0.20) & (score < 3.0))
            | (boost - s["old"] < 0.5)
            | (x["intra_error"] < 200)
        )
        return F.when(s["stop"], s).when(ends, state(s["n"], boost, s["old"], decay, F.lit(True))).otherwise(state(s["n"] + 1, boost, boost, decay, F.lit(False)))

    begin = state(F.lit(0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(False))
    inner = F.lag(F.lit(1)).over(w).isNotNull() & F.lead(F.lit(1)).over(w).isNotNull()
    at = df.withColumn("__gate", inner & _gate(last, this, after)).withColumn("__rows", rows)
    at = at.withColumn("__walk", F.when(F.col("__gate"), F.aggregate("__rows", begin, step)))
    seen = F.col("__walk.n") if whole else F.when(F.col("__walk.stop") | (F.col("__walk.n") == LOOK), F.col("__walk.n")).otherwise(F.col("__walk.n") - 1)
    return at.withColumn(name, F.coalesce((F.col("__walk.boost") > 5.0) & (seen > 3), F.lit(False))).drop("__gate", "__rows", "__walk")


def frames_to_key(df: DataFrame, by: list[str], order: list[str], frequency: int, name: str) -> DataFrame:
    """Adds how many frames a group that begins at each row has: up to the next scene cut, to a change into a still part, or to twice
    the frequency; halved where it is longer than the frequency. frequency 0: up to the end of the stream.

    The change into a still part is told by the product of the last eight decay rates, which the walk holds in a ring, and by as many still
    frames ahead as are left of the frequency.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    if not frequency:
        return df.withColumn(name, F.count(F.lit(1)).over(w.rowsBetween(0, Window.unboundedFollowing)).cast("int"))
    at = scene_cuts(df, by, order, "__cut").withColumn("__rate", decay_rate()).withColumn("__rn", F.row_number().over(w))
    # How many rows from here on are still: up to the next one that is not, or to the end.
    onwards = w.rowsBetween(0, Window.unboundedFollowing)
    moving = F.min(F.when(F.col("__rate") < STILL, F.col("__rn"))).over(onwards)
    at = at.withColumn("__still", F.coalesce(moving, F.max("__rn").over(onwards) + 1) - F.col("__rn"))
    at = at.withColumn("__step", F.struct(F.col("__cut").alias("cut"), F.lead("__rate").over(w).alias("rate"), F.coalesce(F.lead("__still", 2).over(w), F.lit(0)).alias("still")))
    rows = F.collect_list("__step").over(w.rowsBetween(1, 2 * frequency - 1))
    state = lambda i, n, ring, stop: F.struct(i.alias("i"), n.alias("n"), ring.alias("ring"), stop.alias("stop"))

    def step(s: Column, x: Column) -> Column:
        i, longer = s["i"], s["n"] + 1
        ring = F.transform(s["ring"], lambda r, k: F.when(k == i % 8, x["rate"]).otherwise(r))
        product = F.aggregate(ring, F.lit(1.0), lambda a, r: a * r)
        left = F.lit(frequency) - i
        still = (i > LEAST_GROUP) & (x["rate"] >= STILL) & (product < 0.9) & (left > 0) & (x["still"] >= left)
        ends = ((i >= LEAST_GROUP) & x["cut"]) | still
        go_on = state(i + 1, longer, ring, longer >= 2 * frequency)
        return (
            F.when(s["stop"], s)
            .when(x["rate"].isNull(), state(i + 1, longer, s["ring"], F.lit(False)))  # the stream's last row
            .when(ends, state(i, s["n"], ring, F.lit(True)))
            .otherwise(go_on)
        )

    begin = state(F.lit(0), F.lit(1), F.array(*[F.lit(1.0)] * 8), F.lit(False))
    at = at.withColumn("__rows", rows).withColumn("__n", F.aggregate("__rows", begin, step)["n"])
    n = F.col("__n")
    out = at.withColumn(name, F.when(n > frequency, F.floor(n / 2)).otherwise(n).cast("int"))
    return out.drop("__cut", "__rate", "__rn", "__still", "__step", "__rows", "__n")


# What weighs and bounds the boost of a frame, the floor of the decay, and the sums of motion at which a sweep ends.
BOOST_WEIGHT, MOST_BOOST, LEAST_DECAY = 1.5, 48.0, 0.1
MOST_RATIO, MOST_MOVED, LEAST_MOVED = 100.0, 3.0, -2.0


def _frame_boost(x: Column, moved: Column, least_intra: float) -> Column:
    """The boost of a frame: how much better it is predicted than coded by itself, weighed by what moves in or out."""
    divisor = F.when(F.abs(x["coded_error"]) < 1e-12, 1.0).otherwise(x["coded_error"])
    ratio = F.lit(BOOST_WEIGHT) * F.greatest(x["intra_error"], F.lit(least_intra)) / divisor
    return F.least(ratio + ratio * F.when(moved > 0, moved * 2.0).otherwise(moved / 2.0), F.lit(MOST_BOOST))


def _scaled(boost: Column) -> Column:
    return F.shiftright((boost * 100.0).cast("int"), 4)


def group_boost(df: DataFrame, by: list[str], order: list[str], interval: int, least_intra: float, name: str) -> DataFrame:
    """Adds the boost of a group that begins at each row, from the next `interval` rows: the sum of their boosts, each times the
    product of the decay rates up to it. Behind the fourth row, one that adds less than 2 ends the walk where the sum is above 20 or the row is
    weakly predicted; what it has added is taken back. Rows also have mv_in_out."""
    state = lambda i, total, decay, stop: F.struct(i.alias("i"), total.alias("total"), decay.alias("decay"), stop.alias("stop"))

    def step(s: Column, x: Column) -> Column:
        decay = F.greatest(s["decay"] * x["__rate"], F.lit(LEAST_DECAY))
        total = s["total"] + decay * _frame_boost(x, x["mv_in_out"] * x["pcnt_motion"], least_intra)
        ends = (s["i"] > LEAST_GROUP) & ((total > 20.0) | (x["pcnt_inter"] < 0.75)) & (total - s["total"] < 2.0)
        return F.when(ends, state(s["i"], s["total"], decay, F.lit(True))).otherwise(state(s["i"] + 1, total, decay, F.lit(False)))

    begin = state(F.lit(1), F.lit(0.0), F.lit(1.0), F.lit(False))
    inputs = ["pcnt_inter", "pcnt_motion", "mv_in_out", "intra_error", "coded_error", "__rate"]
    out = bounded_walk(df.withColumn("__rate", decay_rate()), by, order, inputs, interval, begin, step, name)
    return out.withColumn(name, _scaled(F.col(f"{name}.total"))).drop("__rate")


def sweep_boosts(df: DataFrame, by: list[str], order: list[str], forward: int, backward: int, least_intra: float) -> DataFrame:
    """Adds f_boost (of this and the next rows, `forward` in all), b_boost (of the `backward` rows before it) and boost, their sum.

    A sweep ends behind the row at which the motion that it has seen is too much: that row still counts. Rows also have mv_in_out, mvr and mvc.
    """
    state = lambda total, decay, moved, far, ratio, stop: F.struct(total.alias("total"), decay.alias("decay"), moved.alias("moved"), far.alias("far"), ratio.alias("ratio"), stop.alias("stop"))

    def step(s: Column, x: Column) -> Column:
        motion = x["pcnt_motion"]
        in_out = x["mv_in_out"] * motion
        share = lambda size, sum_: F.least(F.abs(x[size]) / _safe(F.abs(x[sum_])), x[size]) * motion
        ratio = s["ratio"] + F.when(motion > 0.05, share("mvr_abs", "mvr") + share("mvc_abs", "mvc")).otherwise(0.0)
        moved, far = s["moved"] + in_out, s["far"] + F.abs(in_out)
        decay = F.greatest(s["decay"] * x["__rate"], F.lit(LEAST_DECAY))
        total = s["total"] + decay * _frame_boost(x, in_out, least_intra)
        return state(total, decay, moved, far, ratio, (ratio > MOST_RATIO) | (far > MOST_MOVED) | (moved < LEAST_MOVED))

    zero = F.lit(0.0)
    begin = state(zero, F.lit(1.0), zero, zero, zero, F.lit(False))
    inputs = ["pcnt_motion", "mv_in_out", "mvr", "mvc", "mvr_abs", "mvc_abs", "intra_error", "coded_error", "__rate"]
    out = df.withColumn("__rate", decay_rate())
    out = bounded_walk(out, by, order, inputs, forward, begin, step, "f_boost", 0)
    out = bounded_walk(out, by, order, inputs, backward, begin, step, "b_boost", -1)
    out = out.withColumns({c: _scaled(F.col(f"{c}.total")) for c in ("f_boost", "b_boost")})
    return out.withColumn("boost", F.col("f_boost") + F.col("b_boost")).drop("__rate")
