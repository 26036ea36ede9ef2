"""Whole reports as one aggregation: encode and decode runs, layers, modes, phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import percentiles


def throughput_mb(total_bytes: Column, ns: Column) -> Column:
    """Binary megabytes a second; 0 without time."""
    return F.when(ns > 0, total_bytes / (1024 * 1024) * 1e9 / ns).otherwise(0.0)


def encode_report(frames: DataFrame, by: list[str], order: str) -> DataFrame:
    """frames: by, order, ns, dropped, bytes, quantizer, key_frame. One row a run.

    Times are of all frames, everything else of those that are not dropped. key_bytes is the last key frame's size, not a sum.
    The smallest quantizer starts anew after each 0: a zero counts as 'none yet' until a later frame, so it is the least one
    after the last zero (0 if that was the last frame).
    """
    kept = ~F.col("dropped")
    inter = kept & ~F.col("key_frame")
    last = lambda column, when: F.max(F.when(when, F.struct(order, column)))[column]
    zero = frames.where(kept & (F.col("quantizer") == 0)).groupBy(*by).agg(F.max(order).alias("__zero"))
    after = frames.join(zero, by, "left") if by else frames.crossJoin(zero)  # one row
    out = after.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(kept).alias("encoded"),
        F.count_if(F.col("dropped")).alias("dropped"),
        F.coalesce(F.sum(F.when(kept, F.col("bytes"))), F.lit(0)).alias("bytes"),
        F.coalesce(last("bytes", kept & F.col("key_frame")), F.lit(0)).alias("key_bytes"),
        F.coalesce(F.floor(F.sum(F.when(inter, F.col("bytes"))) / F.count_if(inter)), F.lit(0)).alias("mean_inter_bytes"),
        F.coalesce(F.min(F.when(kept & (F.col("__zero").isNull() | (F.col(order) > F.col("__zero"))), F.col("quantizer"))), F.lit(0)).alias("min_quantizer"),
        F.coalesce(F.max(F.when(kept, F.col("quantizer"))), F.lit(0)).alias("max_quantizer"),
        F.coalesce(F.avg(F.when(kept, F.col("quantizer"))), F.lit(0.0)).alias("mean_quantizer"),
        F.floor(F.sum("ns") / F.count(F.lit(1))).alias("ns_per_frame"),
    )
    return out.join(percentiles(frames, by, "ns", [50, 95, 99]), by) if by else out.crossJoin(percentiles(frames, by, "ns", [50, 95, 99]))  # one row


def decode_report(frames: DataFrame, by: list[str], macroblocks: Column) -> DataFrame:
    """frames: by, ns, bytes, shown. Frames, decoded ones, time, speed and its percentiles of each run."""
    total = frames.groupBy(*by).agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if("shown").alias("decoded"),
        F.floor(F.sum("ns") / F.count(F.lit(1))).alias("ns_per_frame"),
        throughput_mb(F.sum("bytes"), F.sum("ns")).alias("mb_per_s"),
    )
    speed = F.when(F.col("ns_per_frame") > 0, 1e9 / F.col("ns_per_frame")).otherwise(0.0)
    return total.join(percentiles(frames, by, "ns", [50, 95, 99]), by).withColumns({"fps": speed, "macroblocks_per_s": macroblocks * speed})


def rate_mismatch_pct(got: Column, target: Column) -> Column:
    return F.when(target > 0, 100.0 * F.abs(got - target) / target).otherwise(0.0)


def layer_summary(frames: DataFrame, by: list[str], fps: float, targets: list[float]) -> DataFrame:
    """frames: by, layer, bytes, dropped. One row a group with the columns l<N>_<figure> of each layer: frames, encoded, dropped,
    kbps and the mismatch with the layer's target in percent."""
    layers = range(len(targets))
    rows = frames.groupBy(*by, "layer").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(~F.col("dropped")).alias("encoded"), F.count_if("dropped").alias("dropped"), F.coalesce(F.sum(F.when(~F.col("dropped"), F.col("bytes"))), F.lit(0)).alias("bytes")
    )
    target = F.get(F.array(*map(F.lit, map(float, targets))), F.col("layer").cast("int"))
    rows = rows.withColumn("kbps", F.when(F.col("frames") > 0, F.col("bytes") * 8 * fps / (F.col("frames") * 1000.0)).otherwise(0.0))
    rows = rows.withColumn("mismatch_pct", rate_mismatch_pct(F.col("kbps"), target))
    names = ["frames", "encoded", "dropped", "kbps", "mismatch_pct"]
    wide = rows.groupBy(*by).pivot("layer", list(layers)).agg(*[F.first(n).alias(n) for n in names])
    return wide.select(*by, *[F.coalesce(F.col(f"{i}_{n}"), F.lit(0)).alias(f"l{i}_{n}") for i in layers for n in names])


def mode_distribution(blocks: DataFrame, by: list[str], mode: str, size: str, skip: str, modes: int, sizes: int) -> DataFrame:
    """by, kind ('mode', 'size', 'skip', 'total'), value, n: two bounded histograms and the counts of one pass over a block grid."""
    each = F.array(
        F.when(F.col(mode).between(0, modes - 1), F.struct(F.lit("mode").alias("kind"), F.col(mode).cast("bigint").alias("value"))),
        F.when(F.col(size).between(0, sizes - 1), F.struct(F.lit("size").alias("kind"), F.col(size).cast("bigint").alias("value"))),
        F.when(F.col(skip) != 0, F.struct(F.lit("skip").alias("kind"), F.lit(None).cast("bigint").alias("value"))),
        F.struct(F.lit("total").alias("kind"), F.lit(None).cast("bigint").alias("value")),
    )
    return blocks.select(*by, F.explode(F.array_compact(each)).alias("x")).groupBy(*by, "x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def merge_counts(parts: DataFrame, by: list[str], counts: str) -> DataFrame:
    """by and the element-wise sum of an array of counters that workers have counted in parts."""
    at = parts.select(*by, F.posexplode(counts).alias("i", "n")).groupBy(*by, "i").agg(F.sum("n").alias("n"))
    return at.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias(counts))


def last_best(rows: DataFrame, keys: list[str], best: str, order: str) -> DataFrame:
    """Of each key, the last row that was marked as the best so far: the one that was chosen."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.where(best).groupBy(*keys).agg(F.max(F.struct(order, F.struct(*rest).alias("row"))).alias("m")).select(*keys, "m.row.*")


def phase_report(totals: DataFrame, phases: list[str], frames: str) -> DataFrame:
    """phase, ns_per_frame (whole), pct of all phases: one row for each phase of each row; no frames count as one."""
    n = F.greatest(F.col(frames), F.lit(1))
    whole = sum((F.col(p) for p in phases), F.lit(0))
    keep = [c for c in totals.columns if c not in (*phases, frames)]
    each = F.array(*[F.struct(F.lit(p).alias("phase"), F.floor(F.col(p) / n).alias("ns_per_frame"), F.when(whole > 0, F.col(p) * 100.0 / whole).otherwise(0.0).alias("pct")) for p in phases])
    return totals.select(*keep, F.explode(each).alias("x")).select(*keep, "x.*")


def fixture_gaps(metrics: DataFrame, kind: Column) -> DataFrame:
    """fixture, metric, value, kind, gap: a match rate's distance to 100, a gap's size; the order of a listing is rank, metric."""
    at = metrics.withColumn("kind", kind)
    gap = F.when(F.col("kind") == "gap_pp", 100 - F.col("value")).when(F.col("kind") == "gap_raw", F.abs("value"))
    rank = F.when(F.col("kind") == "gap_pp", 0).when(F.col("kind") == "gap_raw", 1).otherwise(2)
    return at.withColumns({"gap": gap, "rank": rank})


def step_summary(lines: DataFrame, by: list[str], order: str, line: str) -> DataFrame:
    """by, skipped (how many cases a step's output says it skipped), last_line, accepted (nothing was skipped)."""
    skips = F.count_if(F.col(line).startswith("--- SKIP:"))
    return lines.groupBy(*by).agg(skips.alias("skipped"), F.max(F.struct(order, line))[line].alias("last_line"), (skips == 0).alias("accepted"))
