"""Interval-window telemetry: tumbling windows, counter deltas, roll-ups and stall detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def summarise_intervals(df: DataFrame, by: list[str], ts: str, value: str, width: str) -> DataFrame:
    """Per key and tumbling window: n, low, high (finite values only), delta (last - first, null unless both are finite), changes
    (neighbouring finite values that differ)."""
    at = df.select(*by, ts, F.window(ts, width)["start"].alias("start"), F.col(value).alias("__raw"), finite(F.col(value)).alias("__v"))
    w = Window.partitionBy(*by, "start").orderBy(ts)
    before = F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = at.withColumn("__change", (F.col("__v") != before).cast("int"))
    return marked.groupBy(*by, "start").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__v").alias("low"),
        F.max("__v").alias("high"),
        (F.max_by("__v", ts) - F.min_by("__v", ts)).alias("delta"),
        F.coalesce(F.sum("__change"), F.lit(0)).alias("changes"),
    )


def roll_up(summary: DataFrame, by: list[str]) -> DataFrame:
    """The next level of summaries: sums (a missing delta counts as 0) and extremes (a missing one does not count)."""
    return summary.groupBy(*by).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(F.coalesce("delta", F.lit(0.0))).alias("delta"), F.sum("changes").alias("changes")
    )


def stalls(df: DataFrame, by: list[str], ts: str, progress: Column, timeout_seconds: int) -> DataFrame:
    """Rows that come while there was no progress for longer than the timeout: by, ts, idle_us."""
    w = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(progress, F.col(ts)), ignorenulls=True).over(w)
    at = df.withColumn("__last", last).withColumn("idle_us", F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("__last").cast("timestamp")))
    return at.where(~progress & (F.col("idle_us") > timeout_seconds * 1_000_000)).drop("__last")


def alerts(summary: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys, alert: one row for each rule that holds for a summary (a null does not)."""
    each = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return summary.select(*keys, F.explode(each).alias("alert"))


def inbound_video(reports: Column, counters: list[str]) -> Column:
    """Counters of the last inbound video report of a variant map of reports, as doubles; null where a counter is not a finite
    number, and the struct's fields are all null without such a report."""
    each = F.map_values(F.from_json(F.to_json(reports), "map<string, struct<type: string, kind: string, mediaType: string, " + ", ".join(f"{c}: double" for c in counters) + ">>"))
    video = F.filter(each, lambda x: (x["type"] == "inbound-rtp") & ((x["kind"] == "video") | (x["mediaType"] == "video")))
    last = F.try_element_at(video, F.lit(-1))
    return F.struct(*[finite(last[c]).alias(c) for c in counters])
