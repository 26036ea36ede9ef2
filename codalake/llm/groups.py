"""Joins and connected components that withstand very large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of ids or pairs that may be broadcast, some 20 MB; beyond it the joins shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, n: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its rows (n, or else counted) are few; df should be a written table."""
    n = df.limit(most + 1).count() if n is None else n
    return F.broadcast(df) if n <= most else df


def components(edges: DataFrame, a: str, b: str, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): the smallest node that each node of the edges reaches.

    Alternates large and small stars (Kiveris and others, 2014) until the edges are stars, which takes a logarithmic
    number of rounds; edges that are stars at once, as most are, take none. The edges of a round replace the last one's.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = scratch.keep("edges", edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
        loose = ends.groupBy("n").agg(F.sum("up").alias("up"), F.min("up").alias("low")).where("up > 1 OR (up = 1 AND low = 0)")
        if loose.isEmpty():
            break
        # Large star: each node's larger neighbours go to the smallest of it and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        edges = scratch.keep("edges", moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in dropped (distinct ids, a written table): by broadcast while these are few, so that texts stay where they are."""
    return docs.join(small(dropped), id_col, "left_anti")


def repeated(df: DataFrame, times: str, index: str, block: int = 10_000) -> DataFrame:
    """Each row of df `times` times (1 at least), numbered from 0 in `index`. Rows with very many are dealt out in blocks."""
    one = df.where(F.col(times) <= block).withColumn(index, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1)))
    many = df.where(F.col(times) > block).withColumn("__low", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(times) - 1, F.lit(block).cast("bigint"))))
    many = many.repartition(F.col("__low"), F.xxhash64(*df.columns))
    high = F.least(F.col("__low") + block, F.col(times)) - 1
    return one.unionByName(many.withColumn(index, F.explode(F.sequence(F.col("__low"), high))).drop("__low"))
