"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

Each text becomes its SHA-256 digest. A Misra-Gries summary (Spark's freqItems) names
every digest that may hold more than `support` of the rows: at most 1/support of them,
whatever the input. Exact counts verify them, and the verified winners are broadcast, so
rows of the largest groups find their group without a shuffle. All other digests have at
most that share of the rows each; they are grouped and joined by an ordinary shuffle,
with counts combined before it.

Results for unusual input: a null text counts as empty, and all empty texts are equal;
an empty table gives an empty result; a row that is there twice counts twice in
group_size and appears twice, both with kept as its doc_id says; other columns are
ignored. A null id never stays unless the whole group has null ids (keep_id is null then).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Share of the rows from which a digest counts as a heavy hitter.
SUPPORT = 0.005


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays.
    """
    keyed = checkpointed(digests(docs, id_col, text_col))
    total = keyed.count()
    group = (F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id"))
    candidates = keyed.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    winners = (
        keyed.join(F.broadcast(candidates), "text_sha256", "left_semi")
        .groupBy("text_sha256")
        .agg(*group)
        .where(F.col("group_size") > support * total)
    )
    winners = checkpointed(winners)  # 1/support rows at most
    heavy = keyed.join(F.broadcast(winners), "text_sha256")
    rest = keyed.join(F.broadcast(winners), "text_sha256", "left_anti")
    groups = rest.groupBy("text_sha256").agg(*group)
    light = rest.join(groups, "text_sha256")
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
