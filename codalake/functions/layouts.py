"""Byte ranges and byte cursors over binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_value(data: Column, place: Column) -> Column:
    """The byte at a place from 0."""
    return F.conv(F.hex(F.substring(data, place + 1, F.lit(1))), 16, 10).cast("int")


def partition_layout(packet: Column, header: Column, first: Column, log2_count: Column, conceal: bool = False) -> Column:
    """first and tokens, as (off, len), of a frame: header bytes, a first partition, a table of 3-byte sizes of all token partitions but
    the last, and these. Null where a range is out of bounds, a token partition empty or their number none of 1, 2, 4, 8.

    conceal: a first partition that is cut short ends with the packet, and from the first size that is missing or wrong the rest of the
    packet is one partition, behind which none is.
    """
    size, count = F.length(packet), F.pow(F.lit(2), log2_count).cast("int")
    cut = header + first
    end = F.least(cut, size) if conceal else cut
    full = 3 * (count - 1)
    table = F.least(full, size - end) if conceal else full
    span = lambda off, n: F.struct(off.cast("bigint").alias("off"), n.cast("bigint").alias("len"))
    state = lambda off, tokens, done, bad: F.struct(off.cast("bigint").alias("off"), tokens.alias("tokens"), done.alias("done"), bad.alias("bad"))
    no, yes = F.lit(False), F.lit(True)

    def step(s: Column, i: Column) -> Column:
        rest = size - s["off"]
        at = end + 3 * i
        given = byte_value(packet, at) + 256 * byte_value(packet, at + 1) + 65536 * byte_value(packet, at + 2)
        last = i == count - 1
        known = F.when(last, rest).when(3 * (i + 1) <= table, given)
        good = (known > 0) & (known <= rest)
        more = F.concat(s["tokens"], F.array(span(s["off"], known)))
        if conceal:
            wrong = state(s["off"], F.when(last, s["tokens"]).otherwise(F.concat(s["tokens"], F.array(span(s["off"], rest)))), yes, no)
        else:
            wrong = state(s["off"], s["tokens"], yes, yes)
        return F.when(s["done"], s).when(F.coalesce(good, no), state(s["off"] + known, more, no, no)).otherwise(wrong)

    begin = state(end + table, F.array().cast("array<struct<off:bigint,len:bigint>>"), no, no)
    walked = F.aggregate(F.sequence(F.lit(0), count - 1), begin, step)
    fits = log2_count.between(0, 3) & (header >= 0) & (first >= 0) & (header <= size) & (end <= size) & (size - end >= table)
    return F.when(fits & ~walked["bad"], F.struct(span(header, end - header).alias("first"), walked["tokens"].alias("tokens")))


def cursor_byte(data: Column, place: int) -> Column:
    """The byte that a cursor gives as its call number `place` (from 0): it begins anew at the end; empty data give 0."""
    return F.when(F.length(data) > 0, byte_value(data, F.pmod(F.lit(place), F.length(data)))).otherwise(0)


def pick(data: Column, place: int, names: list[str]) -> Column:
    """The name at the cursor's byte modulo their number."""
    return F.get(F.array(*map(F.lit, names)), cursor_byte(data, place) % len(names))


# What the bytes of a case stand for.
SIZES = ["16", "32", "48", "64"]
RATE_CONTROLS, DEADLINES, SPEEDS = ["cbr", "vbr", "cq", "q"], ["rt", "good", "best"], ["cpu0", "cpum3", "cpu4", "cpu8"]
TOKENS, RESILIENCE = ["tokens1", "tokens2", "tokens4", "tokens8"], ["noer", "er", "erpart", "erfull"]
LAYER_SPEEDS, LAYER_MODES = ["cpu0", "cpum3", "cpum8"], [["mode1", "mode2"], ["mode5", "mode6"]]


def option_label(data: Column) -> Column:
    """The label of an encoder-options case by its bytes: sizes, rate control, deadline, speed, token partitions (byte 13), error resilience (byte 16)."""
    parts = ["options_w", pick(data, 0, SIZES), "h", pick(data, 1, SIZES)]
    for place, names in ((2, RATE_CONTROLS), (3, DEADLINES), (4, SPEEDS), (13, TOKENS), (16, RESILIENCE)):
        parts += ["_", pick(data, place, names)]
    return F.when(F.length(data) > 0, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("options_empty")


def layer_label(data: Column) -> Column:
    """The label of a layered case by its bytes: shape, speed, mode, a frame count that is not named, threads, error resilience."""
    tail = F.concat(pick(data, 1, LAYER_SPEEDS), F.lit("_"), pick(data, 4, ["t0", "t2"]), pick(data, 5, ["", "_er1"]))
    mode = lambda names: pick(data, 2, names * 2)  # noqa: E731  four values, of which the last bit counts
    shape = cursor_byte(data, 0) % 3
    return F.when(shape == 0, F.concat(F.lit("multires_"), tail)).when(shape == 1, F.concat(F.lit("svc2tl_"), mode(LAYER_MODES[0]), F.lit("_"), tail)).otherwise(F.concat(F.lit("svc3tl_"), mode(LAYER_MODES[1]), F.lit("_"), tail))


def bits(value: Column, n: int) -> Column:
    """A whole number as n binary digits."""
    return F.lpad(F.bin(value.cast("bigint")), n, "0")


def bytes_of_bits(digits: Column) -> Column:
    """Binary digits as bytes, filled up with zeros."""
    count = F.ceil(F.length(digits) / 8).cast("int")
    one = lambda i: F.lpad(F.conv(F.rpad(F.substring(digits, 8 * i + 1, F.lit(8)), 8, "0"), 2, 16), 2, "0")
    return F.when(count > 0, F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), one), ""))).otherwise(F.lit(b""))


def ebml(name: int, body: Column) -> Column:
    """An element with a size of four bytes."""
    width = (name.bit_length() + 7) // 8
    size = F.unhex(F.lpad(F.hex(F.length(body).cast("bigint") + F.lit(0x10000000)), 8, "0"))
    return F.concat(F.lit(name.to_bytes(width, "big")), size, body)
