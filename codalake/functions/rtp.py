"""RTP payload descriptors of VP8 (RFC 7741) and VP9 (RFC 9628), and superframe indexes.

The plain functions work on bytes and raise ValueError for invalid ones; the *_columns functions apply them to a binary
column through Arrow batches, with null for invalid rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

VP8 = "non_reference boolean, start_of_partition boolean, partition_id int, picture_id int, picture_id_15bit boolean, tl0picidx int, temporal_id int, layer_sync boolean, key_index int, size int"
VP9 = (
    "picture_id int, picture_id_15bit boolean, inter_predicted boolean, flexible boolean, start_of_frame boolean, end_of_frame boolean, not_ref_for_upper boolean, "
    "temporal_id int, switching_up boolean, spatial_id int, inter_layer_dep boolean, tl0picidx int, ref_indices array<int>, "
    "ss struct<spatial_layers:int,widths:array<int>,heights:array<int>,groups:array<struct<temporal_id:int,switching_up:boolean,refs:array<int>>>>, size int"
)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("truncated descriptor")
        self.at += 1
        return self.data[self.at - 1]

    def picture_id(self) -> tuple[int, bool]:
        first = self.byte()
        return ((first & 0x7F) << 8 | self.byte(), True) if first & 0x80 else (first, False)


def picture_id_bytes(value: int, wide: bool) -> bytes:
    if not 0 <= value < (1 << 15 if wide else 1 << 7):
        raise ValueError("picture id out of range")
    return bytes([0x80 | value >> 8, value & 0xFF]) if wide else bytes([value])


def parse_vp8(packet: bytes) -> dict:
    """Fields that are not present are None; size is the descriptor's length."""
    if not packet:
        raise ValueError("empty packet")
    rd = _Reader(packet)
    b = rd.byte()
    out = dict.fromkeys(x.split()[0] for x in VP8.split(", "))
    out |= {"non_reference": bool(b & 0x20), "start_of_partition": bool(b & 0x10), "partition_id": b & 0x07}
    ext = rd.byte() if b & 0x80 else 0
    if ext & 0x40 and not ext & 0x20:
        raise ValueError("TL0PICIDX needs a temporal id")
    if ext & 0x80:
        out["picture_id"], out["picture_id_15bit"] = rd.picture_id()
    if ext & 0x40:
        out["tl0picidx"] = rd.byte()
    if ext & 0x30:
        t = rd.byte()
        if ext & 0x20:
            out |= {"temporal_id": t >> 6, "layer_sync": bool(t & 0x20)}
        if ext & 0x10:
            out["key_index"] = t & 0x1F
    return out | {"size": rd.at}


def build_vp8(d: dict) -> bytes:
    has = lambda k: d.get(k) is not None
    if has("tl0picidx") and not has("temporal_id"):
        raise ValueError("TL0PICIDX needs a temporal id")
    ext = has("picture_id") << 7 | has("tl0picidx") << 6 | has("temporal_id") << 5 | has("key_index") << 4
    out = bytes([bool(ext) << 7 | bool(d.get("non_reference")) << 5 | bool(d.get("start_of_partition")) << 4 | (d.get("partition_id") or 0)])
    if ext:
        out += bytes([ext])
    if has("picture_id"):
        out += picture_id_bytes(d["picture_id"], bool(d.get("picture_id_15bit")))
    if has("tl0picidx"):
        out += bytes([d["tl0picidx"]])
    if has("temporal_id") or has("key_index"):
        out += bytes([(d.get("temporal_id") or 0) << 6 | bool(d.get("layer_sync")) << 5 | (d.get("key_index") or 0)])
    return out


def _parse_ss(rd: _Reader) -> dict:
    b = rd.byte()
    layers = (b >> 5) + 1
    ss = {"spatial_layers": layers, "widths": None, "heights": None, "groups": None}
    if b & 0x10:
        sizes = [(rd.byte() << 8 | rd.byte(), rd.byte() << 8 | rd.byte()) for _ in range(layers)]
        ss |= {"widths": [w for w, _ in sizes], "heights": [h for _, h in sizes]}
    if b & 0x08:
        ss["groups"] = []
        for _ in range(rd.byte()):
            g = rd.byte()
            ss["groups"].append({"temporal_id": g >> 5, "switching_up": bool(g & 0x10), "refs": [rd.byte() for _ in range(g >> 2 & 0x03)]})
    return ss


def parse_vp9(packet: bytes) -> dict:
    if not packet:
        raise ValueError("empty packet")
    rd = _Reader(packet)
    b = rd.byte()
    flexible, inter = bool(b & 0x10), bool(b & 0x40)
    names = ["picture_id", "picture_id_15bit", "temporal_id", "switching_up", "spatial_id", "inter_layer_dep", "tl0picidx", "ref_indices", "ss"]
    out = dict.fromkeys(names)
    out |= {"inter_predicted": inter, "flexible": flexible, "start_of_frame": bool(b & 0x08), "end_of_frame": bool(b & 0x04), "not_ref_for_upper": bool(b & 0x01)}
    if b & 0x80:
        out["picture_id"], out["picture_id_15bit"] = rd.picture_id()
    if b & 0x20:
        t = rd.byte()
        out |= {"temporal_id": t >> 5, "switching_up": bool(t & 0x10), "spatial_id": t >> 1 & 0x07, "inter_layer_dep": bool(t & 0x01)}
        if not flexible:
            out["tl0picidx"] = rd.byte()
    if flexible and inter:
        if not b & 0x80:
            raise ValueError("flexible mode needs a picture id")
        refs, more = [], True
        while more:
            if len(refs) == 3:
                raise ValueError("more than three references")
            x = rd.byte()
            refs.append(x >> 1)
            more = bool(x & 0x01)
        out["ref_indices"] = refs
    if b & 0x02:
        out["ss"] = _parse_ss(rd)
    return out | {"size": rd.at}


def build_vp9(d: dict) -> bytes:
    has = lambda k: d.get(k) is not None
    flag = lambda k: bool(d.get(k))
    layered = has("temporal_id") or has("spatial_id")
    refs = d.get("ref_indices") or []
    if len(refs) > 3 or (refs and not (flag("flexible") and flag("inter_predicted"))):
        raise ValueError("references out of place")
    out = bytes([has("picture_id") << 7 | flag("inter_predicted") << 6 | layered << 5 | flag("flexible") << 4 | flag("start_of_frame") << 3 | flag("end_of_frame") << 2 | has("ss") << 1 | flag("not_ref_for_upper")])
    if has("picture_id"):
        out += picture_id_bytes(d["picture_id"], flag("picture_id_15bit"))
    if layered:
        out += bytes([(d.get("temporal_id") or 0) << 5 | flag("switching_up") << 4 | (d.get("spatial_id") or 0) << 1 | flag("inter_layer_dep")])
        if not flag("flexible"):
            out += bytes([d.get("tl0picidx") or 0])
    if flag("flexible") and flag("inter_predicted"):
        if not refs:
            raise ValueError("flexible inter frames need a reference")
        out += bytes([x << 1 | (i < len(refs) - 1) for i, x in enumerate(refs)])
    if has("ss"):
        ss = d["ss"]
        out += bytes([ss["spatial_layers"] - 1 << 5 | (ss["widths"] is not None) << 4 | (ss["groups"] is not None) << 3])
        for w, h in zip(ss["widths"] or [], ss["heights"] or [], strict=True):
            out += bytes([w >> 8, w & 0xFF, h >> 8, h & 0xFF])
        if ss["groups"] is not None:
            out += bytes([len(ss["groups"])])
            for g in ss["groups"]:
                out += bytes([g["temporal_id"] << 5 | g["switching_up"] << 4 | len(g["refs"]) << 2, *g["refs"]])
    return out


def assemble_vp8(fragments: list[bytes], markers: list[bool]) -> bytes:
    """One frame from its packets in order; ValueError where they are no whole frame."""
    out, first, before = b"", None, 0
    for i, packet in enumerate(fragments):
        d = parse_vp8(packet)
        if i == 0 and not (d["start_of_partition"] and d["partition_id"] == 0):
            raise ValueError("the first packet does not start partition 0")
        if d["partition_id"] < before or (i and d["partition_id"] != before and not d["start_of_partition"]):
            raise ValueError("partitions out of order")
        same = {k: v for k, v in d.items() if k not in ("start_of_partition", "partition_id")}
        if first is not None and same != first:
            raise ValueError("descriptors differ within a frame")
        if markers[i] != (i == len(fragments) - 1):
            raise ValueError("the marker is not on the last packet")
        first, before = same, d["partition_id"]
        out += packet[d["size"] :]
    if not fragments:
        raise ValueError("no packets")
    return out


def packetize_vp8(desc: dict, frame: bytes, mtu: int) -> list[tuple[bytes, bool]]:
    head = [build_vp8(desc | {"start_of_partition": s, "partition_id": 0}) for s in (True, False)]
    room = mtu - len(head[0])
    if room <= 0 or not frame:
        raise ValueError("the packet size must exceed the descriptor's, and the frame must not be empty")
    cuts = range(0, len(frame), room)
    return [(head[i > 0] + frame[i : i + room], i + room >= len(frame)) for i in cuts]


def packetize_vp9(desc: dict, frame: bytes, mtu: int) -> list[tuple[bytes, bool]]:
    """The scalability structure goes with the first packet only."""
    first = len(build_vp9(desc | {"start_of_frame": True, "end_of_frame": False}))
    rest = desc | {"ss": None}
    later = len(build_vp9(rest | {"start_of_frame": False, "end_of_frame": False}))
    if mtu <= max(first, later) or not frame:
        raise ValueError("the packet size must exceed the descriptor's, and the frame must not be empty")
    out, at = [], 0
    while at < len(frame):
        room = mtu - (later if at else first)
        last = at + room >= len(frame)
        out.append((build_vp9((rest if at else desc) | {"start_of_frame": at == 0, "end_of_frame": last}) + frame[at : at + room], last))
        at += room
    return out


def assemble_vp9(fragments: list[bytes], markers: list[bool]) -> bytes:
    out, first = b"", None
    for i, packet in enumerate(fragments):
        d = parse_vp9(packet)
        last = i == len(fragments) - 1
        if d["start_of_frame"] != (i == 0) or d["end_of_frame"] != last or markers[i] != last:
            raise ValueError("frame bounds out of place")
        if i and d["ss"] is not None:
            raise ValueError("scalability structure after the first packet")
        same = {k: v for k, v in d.items() if k not in ("start_of_frame", "end_of_frame", "ss", "size")}
        if first is not None and same != first:
            raise ValueError("descriptors differ within a frame")
        first = same
        out += packet[d["size"] :]
    if not fragments:
        raise ValueError("no packets")
    return out


def parse_superframe(packet: bytes) -> list[bytes]:
    """The frames of a superframe (up to eight, whose sizes fill the packet); empty for an ordinary packet."""
    if not packet or packet[-1] & 0xE0 != 0xC0:
        return []
    count, width = (packet[-1] & 0x07) + 1, (packet[-1] >> 3 & 0x03) + 1
    size = 2 + count * width
    if len(packet) < size or packet[-size] != packet[-1]:
        return []
    index = packet[-size + 1 : -1]
    sizes = [int.from_bytes(index[i * width : (i + 1) * width], "little") for i in range(count)]
    if sum(sizes) != len(packet) - size or 0 in sizes:
        raise ValueError("frame sizes do not fill the superframe")
    out, at = [], 0
    for n in sizes:
        out.append(packet[at : at + n])
        at += n
    return out


def pack_superframe(frames: list[bytes]) -> bytes:
    if not 1 <= len(frames) <= 8 or any(not f for f in frames):
        raise ValueError("a superframe has one to eight frames, none of them empty")
    width = max(1, (max(map(len, frames)).bit_length() + 7) // 8)
    if width > 4:
        raise ValueError("frame too large")
    mark = bytes([0xC0 | width - 1 << 3 | len(frames) - 1])
    return b"".join(frames) + mark + b"".join(len(f).to_bytes(width, "little") for f in frames) + mark


def _column(f: Callable[[bytes], object], kind: str):
    @F.pandas_udf(kind)
    def run(packets: pd.Series) -> pd.Series:
        def one(p):
            try:
                return None if p is None else f(bytes(p))
            except ValueError:
                return None

        return packets.map(one)

    return run


def _struct(f: Callable[[bytes], dict], ddl: str):
    names = [p.strip().split()[0] for p in _split(ddl)]

    @F.pandas_udf(ddl)
    def run(packets: pd.Series) -> pd.DataFrame:
        def one(p):
            try:
                return dict.fromkeys(names) if p is None else f(bytes(p))
            except ValueError:
                return dict.fromkeys(names)

        return pd.DataFrame([one(p) for p in packets], columns=names, dtype=object)

    return run


def _split(ddl: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(ddl[at:i])
            at = i + 1
    return [*parts, ddl[at:]]


def vp8_descriptor(packet: Column | str) -> Column:
    return _struct(parse_vp8, VP8)(packet)


def vp9_descriptor(packet: Column | str) -> Column:
    return _struct(parse_vp9, VP9)(packet)


def superframe_frames(packet: Column | str) -> Column:
    return _column(parse_superframe, "array<binary>")(packet)


def packed_superframe(frames: Column | str) -> Column:
    """A superframe from an array of one to eight frames; null otherwise."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(f):
            try:
                return None if f is None else pack_superframe([bytes(x) for x in f])
            except ValueError:
                return None

        return rows.map(one)

    return run(frames)


def vp8_packets(frame: Column | str, mtu: int, desc: dict | None = None) -> Column:
    """array<struct<payload, marker>> of a frame; null for an empty one."""

    @F.pandas_udf("array<struct<payload:binary,marker:boolean>>")
    def run(rows: pd.Series) -> pd.Series:
        cut = lambda f: [{"payload": p, "marker": m} for p, m in packetize_vp8(desc or {}, bytes(f), mtu)] if f else None
        return rows.map(cut)

    return run(frame)


def vp8_frame(fragments: Column | str) -> Column:
    """The frame of an ordered array of structs with payload and marker; null where they are no whole frame."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(f):
            try:
                return None if f is None else assemble_vp8([bytes(x["payload"]) for x in f], [bool(x["marker"]) for x in f])
            except ValueError:
                return None

        return rows.map(one)

    return run(fragments)


def vp9_packets(frame: Column | str, mtu: int, desc: dict | None = None) -> Column:
    """array<struct<payload, marker>> of a frame; null for an empty one."""

    @F.pandas_udf("array<struct<payload:binary,marker:boolean>>")
    def run(rows: pd.Series) -> pd.Series:
        cut = lambda f: [{"payload": p, "marker": m} for p, m in packetize_vp9(desc or {}, bytes(f), mtu)] if f else None
        return rows.map(cut)

    return run(frame)


def vp9_frame(fragments: Column | str) -> Column:
    """The frame of an ordered array of structs with payload and marker; null where they are no whole frame."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        def one(f):
            try:
                return None if f is None else assemble_vp9([bytes(x["payload"]) for x in f], [bool(x["marker"]) for x in f])
            except ValueError:
                return None

        return rows.map(one)

    return run(fragments)


#: Bytes of packets or frames that leave a worker at a time.
_OUT_BYTES = 1 << 20


def _batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, given with their bytes, in batches of about _OUT_BYTES."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 64
        if size > _OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def packet_rows(df: DataFrame, key: str, frame: str, packetize: Callable[[bytes], list[tuple[bytes, bool]]]) -> DataFrame:
    """key, seq (from 0), payload, marker: a row for each packet of each frame, which a worker cuts one at a time; a null or empty frame has none."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for k, f in zip(batch.column(0), batch.column(1), strict=True):
                    data = f.as_py()
                    for seq, (payload, marker) in enumerate(packetize(data) if data else []):
                        yield (k.as_py(), seq, payload, marker), len(payload)

        yield from _batches(rows(), schema)

    ddl = f"`{key}` {kind}, seq int, payload binary, marker boolean"
    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)
    return df.select(key, frame).mapInArrow(run, ddl)


def frame_rows(packets: DataFrame, key: str, assemble: Callable[[list[bytes], list[bool]], bytes]) -> DataFrame:
    """key, frame (null where its packets are no whole frame), packets: from rows of key, seq, payload, marker. They are read in order, and
    a worker holds the packets of one frame."""
    kind = dict(packets.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(now, payloads, markers):
            try:
                whole = assemble(payloads, markers)
            except ValueError:
                whole = None
            return (now, whole, len(payloads)), len(whole or b"")

        def rows():
            now, payloads, markers = None, [], []
            for batch in batches:
                for k, payload, marker in zip(*(batch.column(c) for c in (key, "payload", "marker")), strict=True):
                    k = k.as_py()
                    if payloads and k != now:
                        yield done(now, payloads, markers)
                        payloads, markers = [], []
                    now = k
                    payloads.append(payload.as_py())
                    markers.append(marker.as_py())
            if payloads:
                yield done(now, payloads, markers)

        yield from _batches(rows(), schema)

    ddl = f"`{key}` {kind}, frame binary, packets int"
    schema = to_arrow_schema(packets.sparkSession.createDataFrame([], ddl).schema)
    return packets.select(key, "seq", "payload", "marker").repartition(key).sortWithinPartitions(key, "seq").mapInArrow(run, ddl)


def little_endian(value: Column, width: int) -> Column:
    """A whole number as so many bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("bigint")), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]))


def next_id(value: Column, bits: int) -> Column:
    """A sequence number of so many bits, plus one."""
    return (value + 1).bitwiseAND((1 << bits) - 1)
