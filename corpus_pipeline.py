"""Documents to token ids in five stages; each works on all that the one before kept.

Every stage but the last returns the columns of documents. Rows with a null doc_id pass
the two dedup stages as they are. Repeated rows (same id and text) leave one row after
exact dedup. Rows that share an id but not the text are documents of their own there: each
stays or goes by its text; in near dedup the smallest id, then the smallest text digest, stays.
Null and empty texts are 'und' and go in the first stage, and so does a text without a letter. Very long texts are
judged, hashed, searched and encoded whole. An empty table gives an empty result with the same columns. Columns beside
those of documents are dropped, whatever their names. Ties in language go to the one that sorts first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codalake.llm import common, groups, langid
from codalake.llm.bpe import bpe_round_trip
from codalake.llm.decontaminate import decontaminate
from codalake.llm.exact_dedup import exact_dedup
from codalake.llm.near_dedup import near_dedup
from codalake.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Confidence in the strongest language below which a document is rejected: text in no learned language, or an even
#: mixture of four languages or more.
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter ('und') go, and those whose score is below LEAST_SCORE. A null lang becomes the predicted
    one. Where no text has a language to learn from, every document is 'und' and goes."""
    docs = docs.select(COLUMNS)
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identify(docs, model, carry=COLUMNS[1:])
    good = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return good.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def _digest() -> Column:
    return F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)


def _shared_ids(rows: DataFrame) -> DataFrame:
    """The ids that stand on several rows."""
    return common.checkpointed(rows.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    docs = docs.select(COLUMNS)
    found = common.checkpointed(exact_dedup(docs).where("doc_id IS NOT NULL").select("doc_id", "kept", "text_sha256"))
    dropped = found.where("NOT kept").select("doc_id").distinct()
    many = _shared_ids(found)
    if many.isEmpty():
        return groups.without_ids(docs, common.checkpointed(dropped))
    rest = groups.without_ids(groups.without_ids(docs, many), common.checkpointed(dropped.join(many, "doc_id", "left_anti")))
    hint = groups.small(many)
    pairs = found.where("kept").join(hint, "doc_id", "left_semi").select("doc_id", "text_sha256").distinct()
    some = docs.join(hint, "doc_id", "left_semi").withColumn("text_sha256", _digest()).dropDuplicates(["doc_id", "text_sha256"])
    return rest.unionByName(some.join(pairs, ["doc_id", "text_sha256"], "left_semi").select(COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (5-word shingles, similarity 0.8) the document with the smallest id stays."""
    docs = docs.select(COLUMNS)
    if not _shared_ids(docs).isEmpty():
        keyed = docs.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", _digest().alias("text_sha256"))))
        dropped = near_dedup(keyed, id_col="key").where("doc_id IS NOT NULL AND NOT kept").select(F.col("doc_id").alias("key")).distinct()
        return groups.without_ids(keyed, common.checkpointed(dropped), "key").select(COLUMNS)
    dropped = near_dedup(docs).where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct()
    return groups.without_ids(docs, common.checkpointed(dropped))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs.select(COLUMNS), benchmark, carry=COLUMNS[1:])
    return found.where(F.size("hits") == 0).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded_sha256 (of the text that the ids give)."""
    out = bpe_round_trip(docs.select(COLUMNS), tokenizer_path(), carry=["lang", "source"])
    return out.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("benchmark decontamination", clean),
    ("BPE encoding", tokens),
]

#: Language mixtures, MinHash rounds and BPE have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again."""
    common.ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    top = f"{sc.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if last:
            path = sc._jvm.org.apache.hadoop.fs.Path(last)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        last = f"{top}/{k}"
    return STAGES[-1][1](spark, docs, sf_dir)
