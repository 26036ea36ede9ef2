"""What several of these operators share: session settings, checkpoints, Arrow maps."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: a Python worker holds one batch of texts at a time.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


def tune(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the session's spark.checkpoint.dir; sets a folder only where none is set and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = sc.getConf().get("spark.checkpoint.dir")
    if shared:
        sc.setCheckpointDir(shared)
    elif (sc.master or "").startswith("local[") or sc.master == "local":
        own = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: it cuts the lineage and outlives executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in the folder of spark.checkpoint.dir, which cut the lineage and outlive executors.

    A table replaces the one of the same name, whose files are deleted, so that a loop holds one round's tables only.
    """

    def __init__(self, spark: SparkSession, what: str):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.top = f"{spark.sparkContext.getCheckpointDir()}/{what}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        """Writes df and reads it again."""
        path = f"{self.top}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        self.drop(name)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        sc = self.spark.sparkContext
        for name in names:
            if path := self.paths.pop(name, None):
                found = sc._jvm.org.apache.hadoop.fs.Path(path)
                found.getFileSystem(sc._jsc.hadoopConfiguration()).delete(found, True)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(set(self.paths) - set(names)))


def map_texts(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[tuple[str, str]],
    rows_of: Callable[[list], Iterator[tuple]],
    carry: list[str] | None = None,
) -> DataFrame:
    """Runs rows_of over each batch of texts (UTF-8 bytes or None).

    rows_of gets the texts of a batch and yields (position, *values); the result has
    id_col, any carried columns and the named fields. Only the columns
    named here are read, so other columns of docs, whatever their names, don't matter.
    """
    spark = docs.sparkSession
    tune(spark)
    keep = [id_col, *(carry or [])]
    types = dict(docs.dtypes)
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__text"))
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{n}` {t}" for n, t in fields)])
    shape = spark.createDataFrame([], schema).select(*[n for n, _ in fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at, cols = [], [[] for _ in arrow]
            for i, *values in rows_of(batch.column("__text").to_pylist()):
                at.append(i)
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            if not at:
                continue
            index = pa.array(at, pa.int64())
            kept = [batch.column(c).take(index) for c in keep]
            made = [pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *arrow.names])

    return src.mapInArrow(run, schema)
