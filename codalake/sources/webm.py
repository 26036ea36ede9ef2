"""WebM files: the frames of their VP9 track, with all four kinds of lacing."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# EBML ids.
SEGMENT, TRACKS, TRACK, NUMBER, CODEC = 0x18538067, 0x1654AE6B, 0xAE, 0xD7, 0x86
CLUSTER, SIMPLE, GROUP, BLOCK = 0x1F43B675, 0xA3, 0xA0, 0xA1
PARENTS = {SEGMENT, TRACKS, TRACK, CLUSTER, GROUP}


def vint(data: bytes, at: int, marker: bool) -> tuple[int, int, int]:
    """A variable-length number, the place after it, and its width; marker: the length bit stays in the value."""
    if at >= len(data) or not data[at]:
        raise ValueError("bad variable-length number")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("truncated number")
    value = int.from_bytes(data[at : at + width], "big")
    return (value if marker else value & ((1 << 7 * width) - 1)), at + width, width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of all elements, parents first; a size of all ones reaches to the end of its parent."""
    while at < end:
        name, at, _ = vint(data, at, True)
        size, at, width = vint(data, at, False)
        stop = end if size == (1 << 7 * width) - 1 else at + size
        if stop > end:
            raise ValueError("element reaches beyond its parent")
        yield name, at, stop
        if name in PARENTS:
            yield from elements(data, at, stop)
        at = stop


def laced(data: bytes, kind: int) -> list[bytes]:
    """The frames of a block; kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [data]
    if not data:
        raise ValueError("empty laced block")
    count, at, lengths = data[0] + 1, 1, []
    if kind == 2:
        if (len(data) - 1) % count:
            raise ValueError("fixed lacing does not fit")
        lengths = [(len(data) - 1) // count] * (count - 1)
    elif kind == 1:
        for _ in range(count - 1):
            n = 0
            while True:
                if at >= len(data):
                    raise ValueError("truncated lacing")
                at += 1
                n += data[at - 1]
                if data[at - 1] != 255:
                    break
            lengths.append(n)
    else:
        for i in range(count - 1):
            value, at, width = vint(data, at, False)
            lengths.append(value if i == 0 else lengths[-1] + value - ((1 << 7 * width - 1) - 1))
    out = []
    for n in lengths:
        if n < 0 or at + n > len(data):
            raise ValueError("frame sizes exceed the block")
        out.append(data[at : at + n])
        at += n
    return [*out, data[at:]]


def vp9_packets(data: bytes) -> list[bytes]:
    track = number = None
    out = []
    for name, a, b in elements(data, 0, len(data)):
        if name == TRACK:
            number = None
        elif name == NUMBER:
            number = int.from_bytes(data[a:b], "big")
        elif name == CODEC and data[a:b].rstrip(b"\0") == b"V_VP9" and track is None:
            track = number if number is not None else -1
        elif name in (SIMPLE, BLOCK):
            which, at, _ = vint(data, a, False)
            if track in (which, -1):
                if at + 3 > b:
                    raise ValueError("truncated block")
                out += laced(data[at + 3 : b], data[at + 2] >> 1 & 0x03)
    if track is None:
        raise ValueError("no VP9 track")
    return out


def read_webm(spark: SparkSession, path: str, glob: str = "*.webm") -> DataFrame:
    """path, idx, payload: one row per packet of the VP9 track of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                packets = vp9_packets(content)
                for i in range(0, len(packets), 256):
                    part = packets[i : i + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(i, i + len(part)), pa.int32()), pa.array(part, pa.binary())], names=["path", "idx", "payload"])

    return files.mapInArrow(run, "path string, idx int, payload binary")
