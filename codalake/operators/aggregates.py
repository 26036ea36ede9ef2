"""Histograms, order statistics and means with the exact edge rules of the telemetry reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamped(value: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def histogram(df: DataFrame, value: Column, low: int, high: int, by: list[str] | None = None) -> DataFrame:
    """Sparse counts of the value clamped to [low, high]: by, bin, n."""
    return df.where(value.isNotNull()).groupBy(*(by or []), clamped(value, low, high).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_map(hist: DataFrame, by: list[str]) -> DataFrame:
    """A sparse histogram as one map with text keys; bins are bounded by the clamp."""
    pair = F.struct(F.col("bin").cast("string"), F.col("n"))
    return hist.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("hist"))


def histogram_l1(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum of absolute differences of two sparse histograms, and how many bins differ."""
    joined = a.select("bin", F.col("n").alias("a")).join(b.select("bin", F.col("n").alias("b")), "bin", "full")
    gap = F.abs(F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    return joined.agg(F.coalesce(F.sum(gap), F.lit(0)).alias("l1"), F.count_if(gap > 0).alias("bins_differ"))


def shares_pp(df: DataFrame, by: list[str], kind: str) -> DataFrame:
    """Percentage points of each kind within its group, against its share of everything."""
    n = df.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    total = n.withColumn("pp", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*by)))
    overall = df.groupBy(kind).agg(F.count(F.lit(1)).alias("all_n"))
    whole = overall.agg(F.sum("all_n").alias("whole"))
    overall = overall.join(F.broadcast(whole)).select(kind, (F.col("all_n") * 100.0 / F.col("whole")).alias("all_pp"))  # one row
    return total.join(overall, kind).withColumn("diff_pp", F.col("pp") - F.col("all_pp"))


def running_counts(df: DataFrame, by: list[str], value: str, parts: int = 64) -> DataFrame:
    """by, value, n, upto, total: each distinct value of a group, how often it is there, how many values are not larger, and
    how many there are. Values are dealt to ranges by approximate quantiles of all of them, so that no task holds a
    whole group; the ranges change where values lie, not the counts."""
    at = df.where(F.col(value).isNotNull())
    cuts = at.agg(F.percentile_approx(value, [(i + 1) / parts for i in range(parts - 1)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x < F.col(value))) if cuts else F.lit(0)
    counts = at.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")).withColumn("__part", part)
    sums = counts.groupBy(*by, "__part").agg(F.sum("n").alias("__sum"))
    group = Window.partitionBy(*by)  # a row for each part
    before = F.coalesce(F.sum("__sum").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), before.alias("__before"), F.sum("__sum").over(group).alias("total"))
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    within = Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return counts.join(sums, same).withColumn("upto", F.sum("n").over(within) + F.col("__before")).select(*by, value, "n", "upto", "total")


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, and for each name the value of that rank (from 1; an expression of the column `total`), which is clamped to the group."""
    at = running_counts(df, by, value)
    here = {}
    for name, rank in ranks.items():
        rank = F.least(F.greatest(rank, F.lit(1)), F.col("total"))
        here[name] = F.max(F.when((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank), F.col(value))).alias(name)
    return at.groupBy(*by).agg(*here.values())


def percentiles(df: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """by and p<percent> for each: the value of rank ceil(n * percent / 100), at least 1."""
    return order_statistics(df, by, value, {f"p{p}": F.ceil(F.col("total") * p / 100) for p in percents})


def medians(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: the middle value, or the mean of both middle ones."""
    out = order_statistics(df, by, value, {"__low": F.floor((F.col("total") + 1) / 2), "__high": F.floor(F.col("total") / 2) + 1})
    return out.select(*by, ((F.col("__low") + F.col("__high")) / 2).alias("median"))


def nearest_rank(value: str, percent: int) -> Column:
    """Aggregate for groups of few distinct values: the value of rank ceil(n * percent / 100), at least 1; 0 without values."""
    return F.expr(f"coalesce(percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY `{value}`), 0)")


def upper_median_row(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The row of rank n div 2 + 1 of each group; ties of the first order column are broken by the later ones. Only the
    rows that tie with it are sorted."""
    first, rank = order[0], F.floor(F.col("total") / 2) + 1
    at = running_counts(df, by, first).where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    at = at.select(*by, first, (rank - (F.col("upto") - F.col("n"))).alias("__k"))
    tied = df.join(at, [*by, first]).withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return tied.where("__rn = __k").select(*df.columns)


def geomean_positive(value: Column) -> Column:
    """Aggregate: geometric mean of the positive values; null without any."""
    return F.exp(F.avg(F.when(value > 0, F.ln(value))))


def mean_finite(value: Column) -> Column:
    """Aggregate: mean without NaN and infinities; 0 without values."""
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.coalesce(F.avg(F.when(finite, value)), F.lit(0.0))


def median_or_nan(value: Column) -> Column:
    return F.coalesce(F.median(value), F.lit(float("nan")))


def integer_mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, F.floor(total / n)).otherwise(0)


def padded_range(value: Column, share: float = 0.08) -> list[Column]:
    """Aggregates low and high: the range widened by a share of itself on either side."""
    pad = (F.max(value) - F.min(value)) * share
    return [(F.min(value) - pad).alias("low"), (F.max(value) + pad).alias("high")]


def bitrate_kbps(total_bytes: Column, frames: Column, fps: Column) -> Column:
    return F.when(frames > 0, total_bytes * 8 * fps / (frames * 1000.0)).otherwise(0.0)


def argmax_first(df: DataFrame, by: list[str], measure: str, tie: list[str]) -> DataFrame:
    """The row of the largest measure in each group, the first by `tie` among equals. Combines before the shuffle."""
    rest = [c for c in df.columns if c not in by]
    best = F.min(F.struct(F.col(measure).isNull().alias("__null"), (-F.col(measure)).alias("__size"), *[F.col(c).alias(f"__{c}") for c in tie], F.struct(*rest).alias("row")))
    return df.groupBy(*by).agg(best.alias("best")).select(*by, "best.row.*").select(*df.columns)


def cumulative_layers(df: DataFrame, layer: str, measure: str, layers: int) -> DataFrame:
    """A row of layer k counts in every layer from k up: layer, n, total. Layers are summed first, and then added up."""
    own = df.groupBy(layer).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"))
    spread = own.withColumn("in_layer", F.explode(F.sequence(F.col(layer), F.lit(layers - 1))))
    return spread.groupBy("in_layer").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def drop_reasons(df: DataFrame, reason: str, reasons: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(reason) == r).alias(f"n_{r}") for r in reasons])


def total_without_totals(df: DataFrame, measures: list[str], is_total: str) -> DataFrame:
    """Column sums that skip rows which are totals already, so that adding the total row changes nothing."""
    return df.where(~F.coalesce(F.col(is_total), F.lit(False))).agg(*[F.sum(m).alias(m) for m in measures])


def noise_level(df: DataFrame, by: list[str], variance: str, bins: int = 20, width: int = 100) -> DataFrame:
    """The bin (width 100) with the largest count after a 3-tap sum, the first of equal ones.

    Values up to 1.5 times the range fall into the last bin; larger ones are discarded.
    """
    at = F.floor(F.col(variance) / width).cast("bigint")
    binned = df.where(at < bins + bins // 2).groupBy(*by, F.least(at, F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spread = binned.select(*by, F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "n").where((F.col("bin") >= 0) & (F.col("bin") < bins))
    smooth = spread.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    return argmax_first(smooth, by, "n", ["bin"])


def scene_cuts(blocks: DataFrame, by: list[str], reference: str, intra: str, least_reference: int, high_reference: int, ratio: int = 4, percent: int = 75) -> DataFrame:
    """by, blocks, promotes: whether a frame should become a key frame.

    Its reference error reaches least_reference per block, intra wins (by more than `ratio`) in `percent` of the
    blocks, and as many have a high reference error.
    """
    ref, own = F.col(reference).cast("bigint"), F.col(intra).cast("bigint")
    out = blocks.groupBy(*by).agg(F.count(F.lit(1)).alias("blocks"), F.sum(ref).alias("err"), F.count_if(ref > own * ratio).alias("better"), F.count_if(ref >= high_reference).alias("high"))
    share = lambda c: F.col(c) * 100 >= F.col("blocks") * percent
    return out.select(*by, "blocks", ((F.col("err") >= F.col("blocks") * least_reference) & share("better") & share("high")).alias("promotes"))


def metric_kind(name: Column) -> Column:
    """How a baseline figure reads: a match rate (gap to 100), a gap already, or a plain value."""
    gap = name.contains("_to_") | name.rlike("_(delta|delta_pct|drift|diff|l1)$") | (name == "divergent_rows")
    return F.when(name.endswith("_match_pct"), "gap_pp").when(gap, "gap_raw").otherwise("value")


def layer_sync(df: DataFrame, by: list[str], order: list[str], layer: str, reads: str, writes: str, buffers: list[str]) -> DataFrame:
    """Adds sync: the frame is above the base layer and every buffer that it reads was last written by a lower layer.

    reads and writes: arrays of buffer names. A buffer that nothing has written yet counts as the base layer's.
    """
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col(layer) > 0
    out = df
    for b in buffers:
        writer = F.coalesce(F.last(F.when(F.array_contains(writes, b), F.col(layer)), ignorenulls=True).over(w), F.lit(0))
        out = out.withColumn(f"__{b}", writer)
        ok = ok & (~F.array_contains(reads, b) | (F.col(f"__{b}") < F.col(layer)))
    return out.withColumn("sync", ok).drop(*[f"__{b}" for b in buffers])
