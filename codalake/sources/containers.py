"""Containers as Spark data sources: format("ivf"), format("webm") and format("i420"), and the search for files.

format("ivf") reads files of any size: a file beyond rangeBytes is cut into ranges at frame borders, with a few megabytes in
memory. A task takes one range, or several where there would be more than TASKS tasks. To find the borders of files that
are more than a task's share, the planner reads their frame headers, 12 bytes each, in blocks; tasks cut all other files. With option("payload", "false") no file is cut and tasks read headers only, so that counts and
sizes cost no payload bytes. Writing makes a file for each stream; frames go out as they come, and files appear when the
whole job has succeeded. format("webm") reads the VP9 track of WebM files by ranges of blocks in the same way; its planner
reads the headers of elements and blocks, and a file's bytes are never held as a whole.

Paths are those of any store that pyarrow opens (local ones, file:, s3:, gs:, hdfs:). Call register() once a session.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from decimal import Decimal
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import ivf, webm

#: Bytes of one range, and of the blocks in which a range and frame headers are read.
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 1 << 20
HEADER_BLOCK = 1 << 13
#: How many tasks may read small ranges; with more bytes each takes more of them, up to RANGE_BYTES.
TASKS = 256
HEADERS = "path string, fourcc string, width int, height int, tb_den bigint, tb_num bigint, idx int, pts decimal(20,0), offset bigint, size bigint, first_byte int"


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def below(path: str, glob: str) -> list[tuple[str, int]]:
    """(path, size) of the matching files below a folder, or of the file itself, by path."""
    where, local = store(path)
    info = where.get_file_info(local)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else where.get_file_info(pafs.FileSelector(local, recursive=True))
    scheme = path[: len(path) - len(local)] if path.endswith(local) else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == pafs.FileType.File and (f is info or fnmatch.fnmatch(f.base_name, glob)))


class Blocks:
    """Random access to a file through one block that is held."""

    def __init__(self, path: str, block: int):
        where, local = store(path)
        self.file, self.block, self.at, self.data = where.open_input_file(local), block, 0, b""
        self.size = self.file.size()

    def get(self, at: int, n: int) -> bytes:
        """n bytes, fewer at the file's end."""
        if at < self.at or at + n > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, self.block))
        return self.data[at - self.at : at - self.at + n]

    def close(self) -> None:
        self.file.close()


def headers(blocks: Blocks, start: int, end: int, index: int) -> Iterator[tuple[int, int, int, int]]:
    """(index, pts, payload offset, payload size) of the frames from start to end; anything cut short is an error."""
    at = start
    while at < end:
        head = blocks.get(at, 12)
        if len(head) < 12:
            raise ValueError("truncated frame header")
        size, pts = struct.unpack(ivf.FRAME, head)
        if at + 12 + size > blocks.size:
            raise ValueError("truncated frame")
        yield index, pts, at + 12, size
        at, index = at + 12 + size, index + 1


@dataclass
class Pieces(InputPartition):
    """(path, start, end, index of the first frame) of each piece; a file whose end is None is cut by the task that reads it."""

    pieces: list[tuple[str, int, int | None, int]]


def ranges(blocks: Blocks, most: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, index of the first frame) of the pieces of a file, of about `most` bytes each, cut at frame borders."""
    start, first = 32, 0
    if blocks.size - 32 > most:
        for index, _, at, length in headers(blocks, 32, blocks.size, 0):
            if at + length - start >= most:
                yield start, at + length, first
                start, first = at + length, index + 1
    if start < blocks.size or not first:
        yield start, blocks.size, first


def shares(files: list[tuple[str, int]], most: int) -> int:
    """The bytes that a task takes: one range, or more where there would be more than TASKS of them."""
    return max(most, min(RANGE_BYTES, sum(size for _, size in files) // TASKS))


def packed(pieces: Iterable[tuple[tuple, int]], share: int) -> list[list[tuple]]:
    """Pieces, given with their weights, in lists of about a share each."""
    out, held, total = [], [], 0
    for piece, weight in pieces:
        if held and total + weight > share:
            out.append(held)
            held, total = [], 0
        held.append(piece)
        total += weight
    return [*out, held]


class IvfReader(DataSourceReader):
    """The planner reads headers only of files that are more than a task's share; tasks cut all others, so that a great many small files
    cost it no more than their names."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.glob = schema, options["path"], options.get("glob", "*.ivf")
        self.payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def _cut(self, path: str) -> list[tuple[str, int, int, int]]:
        blocks = Blocks(path, HEADER_BLOCK)
        try:
            return [(path, *piece) for piece in ranges(blocks, self.most)]
        finally:
            blocks.close()

    def partitions(self) -> list[InputPartition]:
        files = below(self.path, self.glob)
        share = shares(files, self.most)
        if self.payload:
            with ThreadPoolExecutor(16) as pool:
                large = dict(zip((large := [f for f, size in files if size - 32 > share]), pool.map(self._cut, large), strict=True))
            pieces = ((p, (p[2] or size) - p[1] + 1024) for path, size in files for p in large.get(path, [(path, 32, None, 0)]))
        else:
            pieces = (((path, 32, None, 0), (size >> 8) + 1024) for path, size in files)  # headers are a small part of a file
        return [Pieces(part) for part in packed(pieces, share)]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        rows, held = [], 0
        for path, start, end, first in partition.pieces:
            blocks = Blocks(path, BLOCK_BYTES if self.payload else HEADER_BLOCK)
            head = ivf.parse_header(blocks.get(0, 32))
            fixed = path, head["fourcc"], head["width"], head["height"], head["tb_den"], head["tb_num"]
            parts = [(start, end, first)] if end is not None else ranges(blocks, self.most) if self.payload else [(start, blocks.size, first)]
            for start, end, first in parts:
                for index, pts, at, size in headers(blocks, start, end, first):
                    if self.payload:
                        rows.append((*fixed, index, Decimal(pts), blocks.get(at, size)))
                        held += size
                    else:
                        rows.append((*fixed, index, Decimal(pts), at, size, blocks.get(at, 1)[0] if size else None))
                    if held > 8 * BLOCK_BYTES or len(rows) >= 8192:
                        yield self.batch(rows, kinds)
                        rows, held = [], 0
            blocks.close()
        if rows:
            yield self.batch(rows, kinds)

    @staticmethod
    def batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


# WebM: a flat walk over the headers of elements; parents are entered.


@dataclass
class BlockPieces(InputPartition):
    """(path, start, end, number of the first packet, track) of each piece; a file whose end is None is cut by the task that reads it."""

    pieces: list[tuple[str, int, int | None, int, int]]


def flat_elements(blocks: Blocks, at: int, end: int, nested: bool = True) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body, stop) of elements in order, parents before what they hold; a size of all ones reaches to the end of the parent.
    nested: an element that reaches beyond its parent is an error (a range from within a parent cannot tell)."""
    ends = [end]
    while at < end:
        while len(ends) > 1 and at >= ends[-1]:
            ends.pop()
        head = blocks.get(at, 16)
        name, place, _ = webm.vint(head, 0, True)
        size, place, width = webm.vint(head, place, False)
        stop = ends[-1] if size == (1 << 7 * width) - 1 else at + place + size
        if stop > ends[-1] and (nested or name not in webm.PARENTS):
            raise ValueError("element reaches beyond its parent")
        yield name, at, at + place, stop
        if name in webm.PARENTS:
            at += place
            if nested:
                ends.append(stop)
        else:
            at = stop


def block_header(blocks: Blocks, body: int, stop: int) -> tuple[int, int, int, int]:
    """(track, kind of lacing, start of the frames, number of frames) of a block."""
    head = blocks.get(body, 16)[: stop - body]
    track, place, _ = webm.vint(head, 0, False)
    if place + 3 > len(head):
        raise ValueError("truncated block")
    kind = head[place + 2] >> 1 & 0x03
    if kind and place + 4 > len(head):
        raise ValueError("empty laced block")
    return track, kind, body + place + 3, head[place + 3] + 1 if kind else 1


def vp9_blocks(path: str) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(start, stop, track, kind of lacing, start of the frames, number of frames, number of the first packet) of the blocks of a file's VP9 track."""
    blocks = Blocks(path, HEADER_BLOCK)
    track = number = None
    first = 0
    try:
        for name, start, body, stop in flat_elements(blocks, 0, blocks.size):
            if name == webm.TRACK:
                number = None
            elif name == webm.NUMBER:
                number = int.from_bytes(blocks.get(body, stop - body), "big")
            elif name == webm.CODEC and track is None and blocks.get(body, stop - body).rstrip(b"\0") == b"V_VP9":
                track = number if number is not None else -1
            elif name in (webm.SIMPLE, webm.BLOCK):
                which, kind, frames, count = block_header(blocks, body, stop)
                if track in (which, -1):
                    yield start, stop, track, kind, frames, count, first
                    first += count
    finally:
        blocks.close()
    if track is None:
        raise ValueError("no VP9 track")


class WebmReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.glob = schema, options["path"], options.get("glob", "*.webm")
        self.most = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))

    def _ranges(self, path: str) -> list[tuple[str, int, int, int, int]]:
        out: list[tuple[str, int, int, int, int]] = []
        for start, stop, track, *_, first in vp9_blocks(path):
            if out and stop - out[-1][1] <= self.most:
                out[-1] = (path, out[-1][1], stop, *out[-1][3:])
            else:
                out.append((path, start, stop, first, track))
        return out

    def partitions(self) -> list[InputPartition]:
        files = below(self.path, self.glob)
        share = shares(files, self.most)
        with ThreadPoolExecutor(16) as pool:
            large = dict(zip((large := [f for f, size in files if size > share]), pool.map(self._ranges, large), strict=True))
        pieces = ((p, (p[2] or size) - p[1]) for path, size in files for p in large.get(path, [(path, 0, None, 0, 0)]))
        return [BlockPieces(part) for part in packed(pieces, share)]

    def read(self, partition: BlockPieces) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(self.schema)
        rows, held = [], 0
        for path, *piece in partition.pieces:
            parts = [piece] if piece[1] is not None else [p[1:] for p in self._ranges(path)]
            blocks = Blocks(path, BLOCK_BYTES)
            for start, end, index, track in parts:
                for name, _, body, stop in flat_elements(blocks, start, end, nested=False):
                    if name not in (webm.SIMPLE, webm.BLOCK):
                        continue
                    which, kind, frames, _ = block_header(blocks, body, stop)
                    if track not in (which, -1):
                        continue
                    for payload in webm.laced(blocks.get(frames, stop - frames), kind):
                        rows.append((path, index, payload))
                        index, held = index + 1, held + len(payload)
                    if held > 8 * BLOCK_BYTES or len(rows) >= 8192:
                        yield IvfReader.batch(rows, kinds)
                        rows, held = [], 0
            blocks.close()
        if rows:
            yield IvfReader.batch(rows, kinds)


class WebmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "webm"

    def schema(self) -> str:
        return "path string, idx int, payload binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WebmReader(schema, dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """(temporary name, final name) of the files of a task."""

    files: list[tuple[str, str]]


class StreamFiles(DataSourceWriter):
    """Writes a file for each stream. Rows of a stream must come together and in order; write_ivf() and write_i420() see to that.

    A task writes under names of its own in a hidden folder. commit() moves the files of the tasks that counted to their
    names, abort() removes the folder, so that no half-written file is ever seen, whatever is run twice or lost.
    """

    def __init__(self, options: dict[str, str], overwrite: bool, suffix: str, head: Callable, body: Callable):
        self.path, self.overwrite, self.suffix, self.head, self.body = options["path"].rstrip("/"), overwrite, suffix, head, body
        self.hidden = f"{self.path}/_pending-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        where, hidden = store(self.hidden)
        where.create_dir(hidden, recursive=True)
        done, out, now, begun, index = [], None, None, False, 0
        for row in rows:
            if not begun or row["stream"] != now:
                if out:
                    out.close()
                begun, now, index = True, row["stream"], 0
                # Nothing that a name holds is taken for a folder or a hidden file.
                name = f"{'s-' + quote(str(now), safe='') if now is not None else 'null'}{self.suffix}"
                part = uuid.uuid4().hex
                out = where.open_output_stream(f"{hidden}/{part}")
                out.write(self.head(row))
                done.append((part, name))
            out.write(self.body(row, index))
            index += 1
        if out:
            out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        where, local = store(self.path)
        hidden = store(self.hidden)[1]
        where.create_dir(local, recursive=True)
        new = {name: part for m in messages if m for part, name in m.files}
        if self.overwrite:
            for path, _ in below(self.path, f"*{self.suffix}"):
                if posixpath.dirname(store(path)[1]) == local and posixpath.basename(path) not in new:
                    where.delete_file(store(path)[1])
        elif taken := new.keys() & {f.base_name for f in where.get_file_info(pafs.FileSelector(local))}:
            self.abort(messages)
            raise FileExistsError(f"{self.path} holds {sorted(taken)[0]} already")
        with ThreadPoolExecutor(16) as pool:
            for _ in pool.map(lambda n: where.move(f"{hidden}/{new[n]}", f"{local}/{n}"), new):
                pass
        self.abort([])

    def abort(self, messages: list[Written | None]) -> None:
        where, hidden = store(self.hidden)
        if where.get_file_info(hidden).type == pafs.FileType.Directory:
            where.delete_dir(hidden)


def _ivf_head(row) -> bytes:
    return struct.pack(ivf.HEADER, ivf.MAGIC, 0, 32, row["fourcc"].encode(), row["width"], row["height"], row["tb_den"], row["tb_num"], row["frames"] & 0xFFFFFFFF, 0)


def _ivf_body(row, index: int) -> bytes:
    payload = bytes(row["payload"])
    return struct.pack(ivf.FRAME, len(payload), index if row["pts"] is None else int(row["pts"])) + payload


def visible(plane: bytes, width: int, height: int, stride: int) -> bytes:
    """The pixels of a plane without what pads its rows."""
    if stride < width or len(plane) < (height - 1) * stride + width * (height > 0):
        raise ValueError("the plane is smaller than its size says")
    return plane[: width * height] if stride == width else b"".join(plane[i * stride : i * stride + width] for i in range(height))


def _i420_body(row, index: int) -> bytes:
    w, h = row["width"], row["height"]
    cw, ch = (w + 1) // 2, (h + 1) // 2
    return visible(bytes(row["y"]), w, h, row["y_stride"]) + visible(bytes(row["u"]), cw, ch, row["u_stride"]) + visible(bytes(row["v"]), cw, ch, row["v_stride"])


class IvfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ivf"

    def schema(self) -> str:
        return ivf.SCHEMA if self.options.get("payload", "true").lower() != "false" else HEADERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return IvfReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return StreamFiles(dict(self.options), overwrite, ".ivf", _ivf_head, _ivf_body)


class I420Source(DataSource):
    """A sink of raw planar frames: visible pixels only."""

    @classmethod
    def name(cls) -> str:
        return "i420"

    def schema(self) -> str:
        raise NotImplementedError("raw frames hold no size to read them by")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return StreamFiles(dict(self.options), overwrite, ".i420", lambda row: b"", _i420_body)


class ChunkSource(DataSource):
    """A sink of files whose bytes come in chunks, for containers that are built as rows."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        raise NotImplementedError("a file does not tell its chunks")

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return StreamFiles(dict(self.options), overwrite, self.options.get("suffix", ".bin"), lambda row: b"", lambda row, index: bytes(row["chunk"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChunkSource)
    spark.dataSource.register(IvfSource)
    spark.dataSource.register(I420Source)
    spark.dataSource.register(WebmSource)


def read_webm(spark: SparkSession, path: str, glob: str = "*.webm", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, idx, payload: one row per packet of the VP9 track of each matching file below path."""
    register(spark)
    return spark.read.format("webm").option("glob", glob).option("rangeBytes", str(range_bytes)).load(path)


def read_ivf(spark: SparkSession, path: str, payload: bool = True, glob: str = "*.ivf", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per frame of the matching files below path; without payload: offset, size and first byte instead."""
    register(spark)
    return spark.read.format("ivf").option("glob", glob).option("payload", str(payload).lower()).option("rangeBytes", str(range_bytes)).load(path)


def summary(frames: DataFrame) -> DataFrame:
    """Frames, payload bytes and key frames (VP8: the first byte's low bit is 0) of each file, from rows without payload."""
    key = F.col("first_byte").bitwiseAND(1) == 0
    return frames.groupBy("path").agg(F.count(F.lit(1)).alias("frames"), F.sum("size").alias("bytes"), F.count_if(key).alias("key_frames"))


def _by_stream(df: DataFrame, stream: str, columns: list[str]) -> DataFrame:
    return df.withColumnRenamed(stream, "stream").select(F.col("stream").cast("string").alias("stream"), *columns).repartition("stream").sortWithinPartitions("stream", "idx")


def write_ivf(df: DataFrame, path: str, stream: str, mode: str = "append") -> None:
    """A file for each stream from its frames: stream, fourcc, width, height, idx, payload, and where they are there tb_den, tb_num (30, 1)
    and pts (0, 1, ...). Frames go out in the order of idx; a null stream's file is null.ivf."""
    register(df.sparkSession)
    given = {"tb_den": F.lit(30).cast("bigint"), "tb_num": F.lit(1).cast("bigint"), "pts": F.lit(None).cast("decimal(20,0)")}
    for name, value in given.items():
        if name not in df.columns:
            df = df.withColumn(name, value)
    df = df.withColumn("frames", F.count(F.lit(1)).over(Window.partitionBy(F.col(stream).cast("string"))))
    _by_stream(df, stream, ["fourcc", "width", "height", "tb_den", "tb_num", "frames", "idx", "pts", "payload"]).write.format("ivf").mode(mode).save(path)


def write_i420(df: DataFrame, path: str, stream: str, mode: str = "append") -> None:
    """A raw file for each stream from its frames: stream, idx, width, height, y, u, v and the strides of these."""
    register(df.sparkSession)
    _by_stream(df, stream, ["idx", "width", "height", "y", "u", "v", "y_stride", "u_stride", "v_stride"]).write.format("i420").mode(mode).save(path)


def write_chunks(df: DataFrame, path: str, stream: str, suffix: str, mode: str = "append") -> None:
    """A file for each stream from its chunks: stream, idx, chunk."""
    register(df.sparkSession)
    _by_stream(df, stream, ["idx", "chunk"]).write.format("chunks").option("suffix", suffix).mode(mode).save(path)


# Files by what they are called and hold


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, name (lower-cased), size of all files below root, or of the file itself; contents are not read. Empty files are not listed, as
    Spark's readers pass over them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.lower(F.element_at(F.split("path", "/"), -1)).alias("name"), F.col("length").alias("size"))


def sniffed(files: DataFrame, n: int = 32) -> DataFrame:
    """files with head, the first n bytes of each; only these are read."""
    schema = StructType([*files.schema.fields, *StructType.fromDDL("head binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = []
            for path in batch.column("path").to_pylist():
                where, local = store(path)
                with where.open_input_file(local) as f:
                    heads.append(f.read(n))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=[*batch.schema.names, "head"])

    return files.mapInArrow(run, schema)


def first_by_path(files: DataFrame, limit: int) -> DataFrame:
    """The first files by path, after all that were accepted are known; 0: all of them."""
    files = files.orderBy("path")
    return files.limit(limit) if limit > 0 else files


def find_ivf(spark: SparkSession, root: str, codec: str, invalid: bool = False, limit: int = 0) -> DataFrame:
    """path, size of the .ivf files of a codec (VP8 or VP9), by path. invalid: those named invalid-* instead.

    VP8 files are judged by their whole header: another codec is passed over, a broken header is an error. VP9 files are judged by magic, header
    size and codec; under `invalid` all of them are taken. A file that is shorter than a header is an error where headers are read.
    """
    files = listing(spark, root).where(F.col("name").endswith(".ivf") & (F.col("name").startswith("invalid-") == F.lit(invalid)))
    if codec == "VP9" and invalid:
        return first_by_path(files.select("path", "size"), limit)
    rows = sniffed(files)
    head = F.col("head")
    short = F.length(head) < 32
    magic = (F.substring(head, 1, 4) == F.lit(ivf.MAGIC)) & (F.substring(head, 7, 2) == F.lit(b"\x20\x00"))
    four = F.substring(head, 9, 4)
    known = four.isin(F.lit(b"VP80"), F.lit(b"VP90"))
    sized = (F.substring(head, 13, 2) != F.lit(b"\0\0")) & (F.substring(head, 15, 2) != F.lit(b"\0\0"))
    if codec == "VP9":
        broken, good = short, magic & (four == F.lit(b"VP90"))
    else:
        broken, good = short | ~magic | (known & ~sized), four == F.lit(b"VP80")
    error = F.raise_error(F.concat(F.col("path"), F.lit(" is not valid IVF data"))).cast("boolean")
    return first_by_path(rows.where(F.when(broken, error).otherwise(good)).select("path", "size"), limit)


def find_webm(spark: SparkSession, root: str, names: list[str] | None = None, profiles: list[int] | None = None, limit: int = 0) -> DataFrame:
    """path, size of the .webm files with one of the names, or whose name begins with vp9<profile>-, by path."""
    files = listing(spark, root).where(F.col("name").endswith(".webm"))
    base = F.element_at(F.split("path", "/"), -1)
    good = base.isin(names) if names is not None else F.substring_index("name", "-", 1).isin([f"vp9{p}" for p in profiles or []])
    return first_by_path(files.where(good & (F.lit(names is not None) | F.col("name").contains("-"))).select("path", "size"), limit)
