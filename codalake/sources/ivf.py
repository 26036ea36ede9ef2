"""IVF files as tables of frames, and back.

Files are read whole through Spark (any store that Spark reads), one task per file;
frames leave the worker one Arrow batch at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Magic, header and frame header layouts (little endian; the denominator of the time base comes first), known codecs.
MAGIC, HEADER, FRAME, CODECS = b"DKIF", "<4sHH4sHHIIII", "<IQ", (b"VP80", b"VP90")
#: Bytes of frames or files that leave a worker at a time.
OUT_BYTES = 8 << 20
SCHEMA = "path string, fourcc string, width int, height int, tb_den bigint, tb_num bigint, idx int, pts decimal(20,0), payload binary"


def parse_header(data: bytes) -> dict:
    if len(data) < 32:
        raise ValueError("file too short for an IVF header")
    magic, _, size, fourcc, width, height, den, num, count, _ = struct.unpack_from(HEADER, data)
    if magic != MAGIC or size != 32 or fourcc not in CODECS or not width or not height:
        raise ValueError("no IVF header of a known codec")
    return {"fourcc": fourcc.decode(), "width": width, "height": height, "tb_den": den, "tb_num": num, "frame_count": count}


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(index, pts, payload); anything cut short is an error. The header's frame count is not trusted."""
    at, i = 32, 0
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("truncated frame header")
        size, pts = struct.unpack_from(FRAME, data, at)
        if at + 12 + size > len(data):
            raise ValueError("truncated frame")
        yield i, pts, data[at + 12 : at + 12 + size]
        at, i = at + 12 + size, i + 1


def build(fourcc: str, width: int, height: int, payloads: list[bytes], den: int = 30, num: int = 1, pts: list[int] | None = None) -> bytes:
    """A whole file; without pts, frames are numbered from 0."""
    head = struct.pack(HEADER, MAGIC, 0, 32, fourcc.encode(), width, height, den, num, len(payloads), 0)
    return head + b"".join(struct.pack(FRAME, len(p), i if pts is None else pts[i]) + p for i, p in enumerate(payloads))


def read_ivf(spark: SparkSession, path: str, glob: str = "*.ivf") -> DataFrame:
    """One row per frame of all matching files below path; a broken file fails the read."""
    return parse_ivf(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content"))


def parse_ivf(files: DataFrame) -> DataFrame:
    """One row per frame of files given as path and content."""
    names = [x.split()[0] for x in SCHEMA.replace("decimal(20,0)", "d").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0
        for batch in batches:
            # One file at a time; frames of many small files leave together.
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data = content.as_py()
                head = parse_header(data)
                fixed = name.as_py(), head["fourcc"], head["width"], head["height"], head["tb_den"], head["tb_num"]
                for index, pts, payload in frames(data):
                    part.append((*fixed, index, Decimal(pts), payload))
                    size += len(payload) + 128
                    if size > OUT_BYTES:
                        yield _batch(names, part)
                        part, size = [], 0
        if part:
            yield _batch(names, part)

    return files.mapInArrow(run, SCHEMA)


def _batch(names: list[str], part: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.decimal128(20, 0), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=names)


def sizes(df: DataFrame) -> DataFrame:
    """Frames and payload bytes of each file, and its key frames by the low bit of the first byte (VP8)."""
    key = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int").bitwiseAND(1) == 0
    return df.groupBy("path").agg(F.count(F.lit(1)).alias("frames"), F.sum(F.length("payload")).alias("bytes"), F.count_if(key).alias("key_frames"))


def build_files(df: DataFrame, stream: str) -> DataFrame:
    """stream, content: the file of each stream from its frames (stream, fourcc, width, height, idx, payload), in order of idx. Frames are
    read in order, and a worker holds one file."""
    kind = dict(df.dtypes)[stream]
    ddl = f"`{stream}` {kind}, content binary"
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files() -> Iterator[tuple]:
            head, payloads = None, []
            for batch in batches:
                columns = [batch.column(c) for c in (stream, "fourcc", "width", "height", "payload")]
                for now, fourcc, width, height, payload in zip(*columns, strict=True):
                    if head is None or now.as_py() != head[0]:
                        if head:
                            yield head[0], build(*head[1:], payloads)
                        head, payloads = (now.as_py(), fourcc.as_py(), width.as_py(), height.as_py()), []
                    payloads.append(payload.as_py())
            if head:
                yield head[0], build(*head[1:], payloads)

        held, size = [], 0
        for name, content in files():
            held.append((name, content))
            size += len(content) + 64
            if size > OUT_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    rows = df.select(stream, "fourcc", "width", "height", "idx", "payload")
    return rows.repartition(stream).sortWithinPartitions(stream, "idx", "payload").mapInArrow(run, ddl)
