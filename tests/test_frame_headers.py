"""Whole frame headers: sizes from reference slots, deltas and features that last, and broken frames that change nothing."""

from pyspark.sql import functions as F

from codalake.functions import layouts
from codalake.operators import frameheaders


def put(*parts) -> bytes:
    """(value, bits) pairs and strings of digits as bytes."""
    digits = "".join(p if isinstance(p, str) else format(p[0], f"0{p[1]}b") for p in parts)
    digits += "0" * (-len(digits) % 8)
    return bytes(int(digits[i : i + 8], 2) for i in range(0, len(digits), 8))


def size(w, h):
    return format(w - 1, "016b") + format(h - 1, "016b")


SYNC = format(0x498342, "024b")


def tail(width, deltas="0", segments="0", columns=0, rows="0", first=7, resilient=False):
    blocks = (width + 63) // 64
    low = next(k for k in range(7) if 64 << k >= blocks)
    high = max(0, next(k for k in range(1, 20) if blocks >> k < 4) - 1)
    tiles = "1" * (columns - low) + ("0" if columns < high else "")
    return ("" if resilient else "10") + "01" + format(33, "06b") + "101" + deltas + format(99, "08b") + "1" + format(5, "04b") + "1" + "00" + segments + tiles + rows + format(first, "016b")


def key(w, h, **more):
    return put("10", "00", "0", "010", SYNC, "0010", size(w, h), "0", tail(w, **more))


def inter(refresh, slots, found, w, h, render="0", shown="1", **more):
    sizes = "".join("1" if i == found else "0" for i in range(3 if found is None else found + 1)) + (size(w, h) if found is None else "")
    return put("10", "00", "0", "1", shown, "0", "" if shown == "1" else "0", "00", (refresh, 8), *[format(s, "03b") + "1" for s in slots], sizes, render, "1", "010", tail(w, **more))


def test_stream():
    s = frameheaders.References()
    run = lambda data: dict(zip(frameheaders._NAMES, s.step(data), strict=True))
    assert run(inter(1, (0, 1, 2), 0, 64, 64))["error"] == "size of an empty reference"
    r = run(key(640, 360, deltas="11" + "1" + format(9, "06b") + "1" + "000" + "00"))
    assert (r["error"], r["width"], r["height"], r["refresh"], r["ref_deltas"], r["mode_deltas"], r["q_deltas"]) == (None, 640, 360, 255, [-9, 0, -1, -1], [0, 0], [-5, 0, 0])
    assert (r["filter_level"], r["sharpness"], r["base_q"], r["first_partition_size"], r["tile_columns_log2"]) == (33, 5, 99, 7, 0)
    r = run(inter(0b100, (3, 4, 5), None, 320, 200, render="1" + size(300, 190)))
    assert (r["width"], r["render_width"], r["refs"], r["sign_biases"], r["size_from"], r["filter"], r["ref_deltas"]) == (320, 300, [3, 4, 5], [1, 1, 1], None, "sharp", [-9, 0, -1, -1])
    r = run(inter(0, (7, 2, 0), 1, 320, 200, rows="11"))
    assert (r["width"], r["size_from"], r["tile_rows_log2"]) == (320, 2, 2)
    features = "0" + "1" + "0" + "1" + format(200, "08b") + "1" + "000" + "000" + "1" + "0000" * 6
    r = run(inter(0, (0, 0, 0), 0, 640, 360, segments="1" + features))
    assert r["segmented"] and r["segment_features"] == 2
    assert run(inter(0, (0, 0, 0), 0, 640, 360))["segment_features"] == 2
    shown = run(put("10", "00", "1", (2, 3)))
    assert (shown["shows_existing"], shown["width"], shown["key_frame"]) == (2, 320, None)
    before = (list(s.sizes), s.ref_deltas)
    for bad, what in ((key(64, 64)[:9], "truncated header"), (b"", "truncated header"), (None, "truncated header"), (b"\x00", "no frame marker"), (b"\xa0", "profile not supported"), (put("10", "00", "0", "010", (1, 24), "0" * 90), "no sync code"), (key(64, 64, first=0), "empty first partition"), (put("10", "00", "0", "010", SYNC, "111", "0" * 90), "colour space not supported")):
        r = run(bad)
        assert r["error"] == what and [v for k, v in r.items() if v is not None] == [what]
    assert (list(s.sizes), s.ref_deltas) == before
    r = run(key(4096, 8, columns=2))
    assert (r["tile_columns_log2"], r["ref_deltas"], r["segment_features"]) == (2, [1, 0, -1, -1], 0)
    intra = put("10", "00", "0", "1", "0", "0", "1", "00", SYNC, (1, 8), size(8, 8), "0", tail(8))
    r = run(intra)
    assert (r["intra_only"], r["refresh"], r["width"], s.sizes[0], s.sizes[1]) == (True, 1, 8, (8, 8), (4096, 8))


def test_frame_headers_over_streams(spark):
    rows = [(1, 0, key(64, 48)), (1, 1, inter(1, (0, 0, 0), None, 32, 16)), (1, 2, inter(0, (0, 1, 2), 0, 32, 16)), (None, 0, key(128, 128)), (None, 1, None), (None, 2, inter(0, (5, 5, 5), 2, 128, 128))]
    df = spark.createDataFrame(rows, "s int, i int, payload binary").repartition(3)
    got = {(r["s"], r["i"]): (r["width"], r["error"]) for r in frameheaders.frame_headers(df, "s", ["i"], "payload").collect()}
    assert got == {(1, 0): (64, None), (1, 1): (32, None), (1, 2): (32, None), (None, 0): (128, None), (None, 1): (None, "truncated header"), (None, 2): (128, None)}
    assert frameheaders.frame_headers(df.limit(0), "s", ["i"], "payload").count() == 0
    digits = spark.createDataFrame([("",), ("1",), ("111111110000000011",)], "d string").select(layouts.bytes_of_bits(F.col("d")), layouts.bits(F.lit(5), 4)).collect()
    assert [(bytes(r[0]), r[1]) for r in digits] == [(b"", "0101"), (b"\x80", "0101"), (b"\xff\x00\xc0", "0101")]
