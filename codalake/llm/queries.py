"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_round_trip
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .langid import fit, held_out, identify
from .licenses import scan_licenses
from .mixing import mix
from .near_dedup import near_dedup
from .pii import scan_pii
from .resampling import resample
from .secrets import scan_secrets
from .substring_dedup import repeated_passages
from .url_filter import filter_urls
from .whitening import whiten


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path() -> str:
    """The byte-level vocabulary: CODALAKE_BYTE_BPE, or the installed public file."""
    if path := os.environ.get("CODALAKE_BYTE_BPE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def span_text(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(kind: str, spans) -> F.Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count base spans; n_added those that the field adds."""
    out = scan_pii(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    return out.select(
        "doc_id",
        *[count_of(k, base) for k in ("email", "ip", "card", "phone")],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: ~x["base"])).cast("bigint").alias("n_added"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_passages(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "end", "n_words", "n_chunks", "first_ids", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda acc, x: acc + x["end"] - x["start"])
    return out.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_window AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS win, len(w[i:i + 9]) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), doc_window AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM fold, (SELECT DISTINCT m FROM item_window) WHERE len(w) >= m)
), hit AS (
  SELECT doc_id, i, d.m, item_id FROM doc_window d JOIN item_window p ON d.m = p.m AND d.win = p.win
), hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM fold f LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin("assign", "access", "hex"))
    return out.select(
        "doc_id",
        *[count_of(k, F.col("spans")) for k in ("assign", "access", "hex")],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("bigint").alias("n_added"),
    )


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """families: of the confirmed notices; notices: family:start:end:probability of all, unknown ones included."""
    out = scan_licenses(read(spark, sf_dir, "documents"))
    known = F.filter("notices", lambda x: x["family"] != "unknown")
    return out.select(
        "doc_id",
        "n_paragraphs",
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), ",").alias("families"),
        F.size(known).cast("bigint").alias("n_notices"),
        (F.size("notices") - F.size(known)).cast("bigint").alias("n_unknown"),
        F.array_join(F.transform("notices", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"], F.round(x["probability"], 3))), ",").alias("notices"),
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(read(spark, sf_dir, "documents"), percent=85, shingle=3)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    out = identify(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.array_join("languages", "+").alias("lang_set"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_round_trip(read(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(read(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 by its table, over the bytes of each different word.
OP12_SQL = r"""
WITH word AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents
), goal AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), crc_table AS (
  SELECT list(c ORDER BY k) AS t FROM (
    SELECT k, list_reduce(list_prepend(k, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS k)
  )
), code AS (
  SELECT w, CAST(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS BIGINT) AS bucket
  FROM (
    SELECT w, list_transform(range(octet_length(encode(w))), lambda i: CAST(('0x' || substr(hex(encode(w)), 2 * i + 1, 2)) AS BIGINT)) AS bytes
    FROM (SELECT w FROM word UNION SELECT w FROM goal)
  ), crc_table
), source AS (
  SELECT bucket, count(*) AS s FROM word JOIN code USING (w) GROUP BY bucket
), target AS (
  SELECT bucket, count(*) AS t FROM goal JOIN code USING (w) GROUP BY bucket
), whole AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM source) AS s_all, (SELECT coalesce(sum(t), 0) FROM target) AS t_all
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS g
  FROM source LEFT JOIN target USING (bucket), whole
), doc AS (
  SELECT doc_id, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM word JOIN code USING (w) JOIN gain USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features,
         coalesce(CAST((g - ((g % n) + n) % n) // n AS BIGINT), 0) AS weight,
         CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) AS h
  FROM documents d LEFT JOIN doc USING (doc_id)
), final AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n_docs FROM final WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n_docs // 100 THEN place END AS rank
FROM final LEFT JOIN placed USING (doc_id)
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(read(spark, sf_dir, "documents"), [5, 2, 1])
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_decontaminate": op4_decontaminate,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_secrets": op6_secrets,
    "op7_licenses": op7_licenses,
    "op8_near_dedup": op8_near_dedup,
    "op9_langid": op9_langid,
    "op10_bpe": op10_bpe,
    "op11_whitening": op11_whitening,
    "op12_resampling": op12_resampling,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {"op4_decontaminate": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op12_resampling": OP12_SQL}
