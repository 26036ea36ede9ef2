"""What the first bytes of a coded frame say: VP8 frame tags as SQL expressions, VP9 headers through Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(payload: Column, i: int) -> Column:
    """Byte i (from 0) as a number; null beyond the end."""
    return F.conv(F.hex(F.substring(payload, i + 1, 1)), 16, 10).cast("int")


def vp8_info(payload: Column) -> Column:
    """key_frame, profile, show_frame, first_partition_size, width, height (key frames only); null for what is no frame tag."""
    b = [byte_at(payload, i) for i in range(10)]
    key = b[0].bitwiseAND(1) == 0
    started = (b[3] == 0x9D) & (b[4] == 0x01) & (b[5] == 0x2A)
    size = lambda low, high: b[low] + b[high].bitwiseAND(0x3F) * 256
    valid = (F.length(payload) >= 3) & (~key | ((F.length(payload) >= 10) & started))
    whole = b[0] + b[1] * 256 + b[2] * 65536
    return F.when(
        valid,
        F.struct(
            key.alias("key_frame"),
            F.shiftright(b[0], 1).bitwiseAND(7).alias("profile"),
            (F.shiftright(b[0], 4).bitwiseAND(1) == 1).alias("show_frame"),
            F.shiftright(whole, 5).alias("first_partition_size"),
            F.when(key, size(6, 7)).alias("width"),
            F.when(key, size(8, 9)).alias("height"),
        ),
    )


def is_key_frame(payload: Column) -> Column:
    return byte_at(payload, 0).bitwiseAND(1) == 0


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data[:64], "big"), 8 * min(64, len(data))

    def __call__(self, n: int) -> int:
        if n > self.left:
            raise ValueError("truncated header")
        self.left -= n
        return self.value >> self.left & ((1 << n) - 1)


VP9 = (
    "profile int, show_existing_frame boolean, existing_frame_slot int, key_frame boolean, show_frame boolean, error_resilient boolean, intra_only boolean, "
    "refresh_frame_flags int, width int, height int, frame_size_from_reference boolean"
)
_NAMES = [x.split()[0] for x in VP9.split(", ")]


def vp9_header(packet: bytes) -> dict:
    """The uncompressed header's start (profile 0); what is not coded is None, a size that is taken from a reference is too."""
    bits = _Bits(packet)
    out = dict.fromkeys(_NAMES)
    if bits(2) != 2:
        raise ValueError("no frame marker")
    out["profile"] = bits(1) | bits(1) << 1
    if out["profile"]:
        raise ValueError("profile not supported")
    out["show_existing_frame"] = bool(bits(1))
    if out["show_existing_frame"]:
        return out | {"existing_frame_slot": bits(3)}
    out |= {"key_frame": not bits(1), "show_frame": bool(bits(1)), "error_resilient": bool(bits(1)), "intra_only": False, "frame_size_from_reference": False}

    def size():
        return {"width": bits(16) + 1, "height": bits(16) + 1}

    def sync():
        if bits(24) != 0x498342:
            raise ValueError("no sync code")

    if out["key_frame"]:
        sync()
        if bits(3) == 7:
            raise ValueError("colour space not supported")
        bits(1)
        return out | {"refresh_frame_flags": 0xFF} | size()
    out["intra_only"] = bool(bits(1)) if not out["show_frame"] else False
    if not out["error_resilient"]:
        bits(2)
    if out["intra_only"]:
        sync()
        return out | {"refresh_frame_flags": bits(8)} | size()
    out["refresh_frame_flags"] = bits(8)
    for _ in range(3):
        bits(4)
    for _ in range(3):
        if bits(1):
            return out | {"frame_size_from_reference": True}
    return out | size()


def vp9_info(payload: Column | str) -> Column:
    @F.pandas_udf(VP9)
    def run(packets: pd.Series) -> pd.DataFrame:
        def one(p):
            try:
                return vp9_header(bytes(p)) if p is not None else dict.fromkeys(_NAMES)
            except ValueError:
                return dict.fromkeys(_NAMES)

        return pd.DataFrame([one(p) for p in packets], columns=_NAMES, dtype=object)

    return run(payload)


def payload_sha8(payload: Column) -> Column:
    """The first 8 bytes of the SHA-256 in hex, a colon, and the length."""
    return F.concat(F.substring(F.sha2(payload, 256), 1, 16), F.lit(":"), F.length(payload).cast("string"))
