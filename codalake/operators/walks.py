"""Walks along a stream that end early, and distances between marked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_valid_before_gap(df: DataFrame, by: list[str], frame: str, value: Column, valid: Column, name: str, default) -> DataFrame:
    """The value of the first later frame that is valid; the default where a frame number is missing before it.

    Runs of consecutive numbers are islands (number less place is constant), and a walk stays in its island.
    """
    stream = Window.partitionBy(*by).orderBy(frame)
    at = df.withColumn("__island", F.col(frame) - F.row_number().over(stream))
    later = Window.partitionBy(*by, "__island").orderBy(frame).rowsBetween(1, Window.unboundedFollowing)
    return at.withColumn(name, F.coalesce(F.first(F.when(valid, value), ignorenulls=True).over(later), F.lit(default))).drop("__island")


def bounded_walk(df: DataFrame, by: list[str], order: list[str], inputs: list[str], most: int, start: Column, step, name: str, first: int = 1) -> DataFrame:
    """Adds the state after a walk over the next rows, `most` at the most, beginning `first` rows ahead (-1: backwards from the
    row before). step(state, row) gives the next state, a struct with a boolean `stop`; a state that has stopped stays."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() if first < 0 else F.col(c) for c in order])
    rows = F.collect_list(F.struct(*inputs)).over(w.rowsBetween(abs(first), abs(first) + most - 1))
    return df.withColumn("__rows", rows).withColumn(name, F.aggregate("__rows", start, lambda s, x: F.when(s["stop"], s).otherwise(step(s, x)))).drop("__rows")


def decayed_boost(df: DataFrame, by: list[str], order: list[str], score: str, decay: str, stop: str, most: int, name: str, backwards: bool = False) -> DataFrame:
    """The sum of the scores of the next (or the last) rows, each times the product of the decays up to it, which never falls
    below 0.1. A row whose `stop` is true is counted and ends the walk."""
    state = lambda total, product, end: F.struct(total.alias("total"), product.alias("product"), end.alias("stop"))

    def step(s: Column, x: Column) -> Column:
        product = F.greatest(s["product"] * x[decay], F.lit(0.1))
        return state(s["total"] + product * x[score], product, F.coalesce(x[stop], F.lit(False)))

    out = bounded_walk(df, by, order, [score, decay, stop], most, state(F.lit(0.0), F.lit(1.0), F.lit(False)), step, name, -1 if backwards else 1)
    return out.withColumn(name, F.col(f"{name}.total"))


def wait_until(df: DataFrame, by: list[str], ts: str, ready: str, value: str, timeout: Column) -> DataFrame:
    """by, outcome, value: of each key's first poll that is ready before the timeout since its first poll, or else `timeout` and the
    latest poll before that. Of polls at one time the smallest ready value counts, or the largest value. Two aggregates, which
    combine before they shuffle; the first gives a row for each key."""
    starts = df.groupBy(*by).agg(F.min(ts).alias("__start")).select(*[F.col(c).alias(f"__{c}") for c in by], "__start")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    polls = df.join(starts, same).where(F.col(ts) < F.col("__start") + timeout)
    at = F.struct(F.col(ts), F.col(value).alias("value"))
    found = polls.groupBy(*by).agg(F.min(F.when(F.col(ready), at)).alias("first"), F.max(at).alias("last"))
    outcome = F.when(F.col("first").isNotNull(), "ready").otherwise("timeout")
    return found.select(*by, outcome.alias("outcome"), F.coalesce("first", "last")["value"].alias(value))


# Weights of the last five distances between key frames, oldest first.
KEY_WEIGHTS = [1, 2, 3, 4, 5]


def key_distance(df: DataFrame, by: list[str], frame: str, key: str, bootstrap: int) -> DataFrame:
    """by, frame, distance of each key frame after the first: the weighted mean (whole) of the last five distances between key
    frames. Before there are five, the oldest known place is filled with `bootstrap` and older ones count as 0."""
    stream = Window.partitionBy(*by).orderBy(frame)
    keys = df.where(key).select(*by, frame).withColumns({"__d": F.col(frame) - F.lag(frame).over(stream), "__k": F.row_number().over(stream)})
    total = F.lit(0)
    for i, weight in enumerate(reversed(KEY_WEIGHTS)):
        # The first key frame has stored the bootstrap as its distance.
        at = F.lag(F.when(F.col("__k") == 1, F.lit(bootstrap)).otherwise(F.col("__d")), i).over(stream)
        total = total + weight * F.coalesce(at, F.lit(0))
    mean = F.greatest(F.floor(total / sum(KEY_WEIGHTS)), F.lit(1))
    return keys.withColumn("distance", mean).where("__k > 1").select(*by, frame, "distance")


def first_byte_difference(a: Column, b: Column) -> Column:
    """The place (from 0) of the first byte that differs; the shorter length if one is the other's beginning; -1 for equal ones.

    A binary search over the lengths of equal beginnings, so each byte is compared a logarithmic number of times.
    """
    n = F.least(F.length(a), F.length(b))
    same = lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)
    bounds = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        return F.when(s["low"] >= s["high"], s).otherwise(F.when(same(mid), F.struct(mid.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (mid - 1).cast("int").alias("high"))))

    prefix = F.aggregate(F.sequence(F.lit(1), F.lit(32)), bounds, halve)["low"]
    return F.when(a == b, F.lit(-1)).otherwise(prefix)
