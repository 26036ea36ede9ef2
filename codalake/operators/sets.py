"""Set operations on keys and arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """Of two duplicate-free arrays; 1.0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_of_groups(df: DataFrame, group: str, member: str, pairs: DataFrame) -> DataFrame:
    """Jaccard of the member sets of the groups named in pairs (a, b), by counting joins instead of gathered sets."""
    m = df.select(group, member).distinct()
    size = m.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    left = pairs.join(m.withColumnRenamed(group, "a"), "a")
    both = left.join(m.withColumnRenamed(group, "b"), ["b", member]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    out = pairs.join(both, ["a", "b"], "left")
    for side in ("a", "b"):
        out = out.join(size.select(F.col(group).alias(side), F.col("n").alias(f"n_{side}")), side, "left")
    na, nb, n = (F.coalesce(c, F.lit(0)) for c in ("n_a", "n_b", "n_both"))
    union = na + nb - n
    return out.select("a", "b", F.when(union == 0, 1.0).otherwise(n / union).alias("jaccard"))


def except_both_ways(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity: side is 'missing' or 'unexpected'."""
    missing = expected.exceptAll(actual).withColumn("side", F.lit("missing"))
    return missing.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("unexpected")))


def union_keys(df: DataFrame, maps: str) -> DataFrame:
    """The distinct keys of a map column."""
    return df.select(F.explode(F.map_keys(maps)).alias("key")).distinct()


def first_rows(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    """The first rows by an order that has no ties: the cap of a listing."""
    return df.orderBy(*order).limit(most)


def numbered_first(df: DataFrame, order: list[str], most: int, name: str) -> DataFrame:
    """The first rows with their number from 0; fewer where there are fewer. Only `most` rows are numbered."""
    few = df.orderBy(*order).limit(max(0, most))
    return few.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint")).select(name, *df.columns)


def equal_lists(df: DataFrame, by: list[str], order: list[str], a: str, b: str) -> DataFrame:
    """by, same: whether two columns are equal row by row in each group; compared row by row, without gathering them."""
    return df.groupBy(*by).agg((F.count_if(~F.col(a).eqNullSafe(F.col(b))) == 0).alias("same"))


def finite_union(df: DataFrame, keys: list[str], series: list[str], name: str) -> DataFrame:
    """keys and every finite value of the series, with repetitions."""
    return df.select(*keys, F.explode(F.array(*series)).alias(name)).where(F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf")))
