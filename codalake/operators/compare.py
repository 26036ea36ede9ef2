"""Comparing two tables row by row: by key, by position, or in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_row_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of a key, the last by `order`. Combines before the shuffle, as a window would not."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*order, F.struct(*rest).alias("row")))
    return df.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.row.*")


def keyed_compare(left: DataFrame, right: DataFrame, keys: list[str], value: str, order: list[str] | None = None) -> DataFrame:
    """One row of parity figures of left (every row) against right (one row a key, the last by `order`).

    n_left, n_right, matched, left_only, right_only, mean and max absolute delta, and the
    match rate in percent of the longer side.
    """
    a = left.select(*keys, F.col(value).alias("a"), F.lit(1).alias("in_a"))
    b = right if order is None else last_row_wins(right, keys, order)
    b = b.select(*keys, F.col(value).alias("b"), F.lit(1).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    delta = F.when(both, F.abs(F.col("a") - F.col("b")))
    # Sides are counted by themselves: in the join, one right row stands beside each left row of its key.
    sizes = a.agg(F.count(F.lit(1)).alias("n_left")).join(b.agg(F.count(F.lit(1)).alias("n_right")))  # one row each
    one = a.join(b, keys, "full").agg(
        F.count_if(both).alias("matched"),
        F.count_if(F.col("in_b").isNull()).alias("left_only"),
        F.count_if(F.col("in_a").isNull()).alias("right_only"),
        F.coalesce(F.avg(delta), F.lit(0.0)).alias("mean_abs_delta"),
        F.coalesce(F.max(delta), F.lit(0.0)).alias("max_abs_delta"),
    )
    total = F.greatest("n_left", "n_right")
    return sizes.join(one).withColumn("match_pct", F.when(total > 0, F.col("matched") * 100.0 / total).otherwise(0.0))


def match_rates(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], unmatched_fail: bool) -> DataFrame:
    """Percent of rows whose fields agree (null-safe).

    unmatched_fail: left rows without a partner count as failures of every field (a left
    join); otherwise they don't count at all (an inner join). Two different questions.
    """
    b = right.select(*keys, *[F.col(f).alias(f"{f}__r") for f in fields], F.lit(True).alias("__hit"))
    joined = left.join(b, keys, "left" if unmatched_fail else "inner")
    rate = lambda f: F.coalesce(F.avg((F.col("__hit").isNotNull() & F.col(f).eqNullSafe(F.col(f"{f}__r"))).cast("double")) * 100, F.lit(0.0))
    return joined.agg(F.count(F.lit(1)).alias("n"), *[rate(f).alias(f"{f}_match_pct") for f in fields])


def full_outer_divergences(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per key of either side: both values and whether they differ (absent differs from present)."""
    a = left.select(*keys, F.col(value).alias("left_value"))
    b = right.select(*keys, F.col(value).alias("right_value"))
    return a.join(b, keys, "full").withColumn("differs", ~F.col("left_value").eqNullSafe(F.col("right_value")))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def zip_positional(left: DataFrame, right: DataFrame, by: list[str], order: list[str], how: str = "inner") -> DataFrame:
    """The k-th row of left beside the k-th of right in each group; inner ends with the shorter side."""
    a = numbered(left, by, order).select(*by, "position", F.struct(*[c for c in left.columns if c not in by]).alias("l"))
    b = numbered(right, by, order).select(*by, "position", F.struct(*[c for c in right.columns if c not in by]).alias("r"))
    return a.join(b, [*by, "position"], how)


def first_mismatch(zipped: DataFrame, by: list[str], same: Column) -> DataFrame:
    """Matches and the first position that differs (-1: none) of each group of a full positional zip."""
    return zipped.groupBy(*by).agg(
        F.count_if(F.coalesce(same, F.lit(False))).alias("matches"),
        F.coalesce(F.min(F.when(~F.coalesce(same, F.lit(False)), F.col("position"))), F.lit(-1)).alias("first_mismatch"),
    )


def compare_transitions(left: DataFrame, right: DataFrame, by: list[str], order: list[str], index: str, dropped: str, always: list[str], kept: list[str], spreads: list[str]) -> DataFrame:
    """by, n, <field>_mismatches and <field>_spread of two series of equal length: how many positions differ in each field (those of `kept`
    count only where neither row is dropped), and the largest absolute difference of the others. A series that is longer than
    the other, or a position whose indexes differ, is an error."""
    zipped = zip_positional(left, right, by, order, "full")
    of = lambda c: (F.col(f"l.{c}"), F.col(f"r.{c}"))
    one_side = F.col("l").isNull() | F.col("r").isNull()
    wrong = F.when(one_side, F.raise_error(F.concat(F.lit("series of unequal length at position "), F.col("position")))).when(
        ~of(index)[0].eqNullSafe(of(index)[1]), F.raise_error(F.concat(F.lit("indexes differ at position "), F.col("position")))
    )
    both = ~(F.coalesce(of(dropped)[0], F.lit(False)) | F.coalesce(of(dropped)[1], F.lit(False)))
    differs = lambda c: ~of(c)[0].eqNullSafe(of(c)[1])
    counts = [F.count_if(differs(c)).alias(f"{c}_mismatches") for c in always] + [F.count_if(both & differs(c)).alias(f"{c}_mismatches") for c in kept]
    spread = [F.coalesce(F.max(F.abs(of(c)[0] - of(c)[1])), F.lit(0)).alias(f"{c}_spread") for c in spreads]
    checked = F.count(F.when(wrong.cast("string").isNull(), F.lit(1)))
    return zipped.groupBy(*by).agg(checked.alias("n"), *counts, *spread)


def drop_aware_same(left_dropped: Column, right_dropped: Column, left_bytes: Column, right_bytes: Column) -> Column:
    """Two dropped rows match, one does not, and else the bytes are equal and not empty."""
    return F.when(left_dropped & right_dropped, True).when(left_dropped | right_dropped, False).otherwise((left_bytes == right_bytes) & (F.length(left_bytes) > 0))


def within(a: Column, b: Column, tolerance: Column) -> Column:
    """Absolute tolerance, inclusive; a negative one never holds."""
    return (tolerance >= 0) & (F.abs(a - b) <= tolerance)


def relative_error_pct(a: Column, b: Column, floor: float) -> Column:
    """|a - b| in percent of |b|, which counts as `floor` at least."""
    return F.abs(a - b) / F.greatest(F.abs(b), F.lit(floor)) * 100


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is not positive."""
    return F.when(b > 0, a / b).otherwise(0.0)


def gap_argmax(zipped: DataFrame, by: list[str], gap: Column) -> DataFrame:
    """The position of the largest positive gap, the first of equal ones; -1 and 0 where none is positive."""
    best = F.max(F.struct(F.when(gap > 0, gap).alias("gap"), (-F.col("position")).alias("at")))
    out = zipped.groupBy(*by).agg(best.alias("best"))
    found = F.col("best.gap").isNotNull()
    return out.select(*by, F.when(found, -F.col("best.at")).otherwise(-1).alias("position"), F.when(found, F.col("best.gap")).otherwise(0.0).alias("gap"))


def tolerance_violations(zipped: DataFrame, tolerances: dict[str, tuple[float, float]]) -> DataFrame:
    """How many zipped rows leave each column's (absolute, relative) tolerance: a difference may be as large as the larger of both."""
    def out(c: str, absolute: float, relative: float) -> Column:
        a, b = F.col(f"l.{c}"), F.col(f"r.{c}")
        return F.count_if(F.abs(a - b) > F.greatest(F.lit(absolute), F.abs(b) * relative)).alias(f"{c}_out")

    return zipped.agg(F.count(F.lit(1)).alias("n"), *[out(c, *t) for c, t in tolerances.items()])


def signed_extreme(values: Column, order: Column) -> Column:
    """Aggregate: the signed value of the largest magnitude, the first of equal ones."""
    return F.max(F.struct(F.abs(values).alias("size"), (-order).alias("at"), values.alias("value")))["value"]


def matched_prefix(zipped: DataFrame, by: list[str], same: Column) -> DataFrame:
    """Length of the longest common prefix of each group of a full positional zip."""
    ok = F.coalesce(same, F.lit(False))
    return zipped.groupBy(*by).agg((F.coalesce(F.min(F.when(~ok, F.col("position"))), F.max("position") + 1) - 1).alias("prefix"))


def zip_many(series: list[DataFrame], by: list[str], order: list[str]) -> DataFrame:
    """The k-th rows of several tables side by side in each group, as far as the shortest goes: by, position and their values.

    All sides are numbered in one pass and meet in one aggregation, not in a join for each.
    """
    names = [[c for c in s.columns if c not in (*by, *order)] for s in series]
    tagged = None
    for i, (s, own) in enumerate(zip(series, names, strict=True)):
        at = numbered(s, by, order).select(*by, "position", F.lit(i).alias("__i"), *[F.col(c) if k == i else F.lit(None).cast(dict(series[k].dtypes)[c]).alias(c) for k, cols in enumerate(names) for c in cols])
        tagged = at if tagged is None else tagged.unionByName(at)
    out = tagged.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("__n"), *[F.max(F.when(F.col("__i") == i, F.col(c))).alias(c) for i, cols in enumerate(names) for c in cols])
    return out.where(F.col("__n") == len(series)).drop("__n")


def join_by_pts(frames: DataFrame, source: DataFrame, pts: str, index: str, key: str) -> DataFrame:
    """Each frame with its source by timestamp, or by index where the timestamp is not below the number of source frames."""
    size = F.broadcast(source.agg(F.count(F.lit(1)).alias("__size")))  # one row
    at = frames.join(size).withColumn("__at", F.when((F.col(pts) >= 0) & (F.col(pts) < F.col("__size")), F.col(pts)).otherwise(F.col(index)))
    return at.join(source, F.col("__at") == F.col(key)).drop("__at", "__size")


def post_drop_drift(df: DataFrame, by: list[str], order: list[str], left: Column, right: Column) -> DataFrame:
    """One row: how far the next kept values of both sides differ after each row that either side drops (its value is null
    there): max_drift, mean_drift, left_mean, right_mean, n. Rows without a next value on one side don't count."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    at = df.select((left.isNull() | right.isNull()).alias("__drop"), F.first(left, ignorenulls=True).over(w).alias("l"), F.first(right, ignorenulls=True).over(w).alias("r"))
    some = at.where(F.col("__drop") & F.col("l").isNotNull() & F.col("r").isNotNull())
    drift = F.abs(F.col("l") - F.col("r"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return some.agg(zero(F.max(drift)).alias("max_drift"), zero(F.avg(drift)).alias("mean_drift"), zero(F.avg("l")).alias("left_mean"), zero(F.avg("r")).alias("right_mean"), F.count(F.lit(1)).alias("n"))
