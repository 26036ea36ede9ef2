import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codalake.functions import headers, quality, rtp, sdp

opt = lambda s: st.none() | s


@settings(max_examples=200, deadline=None)
@given(st.booleans(), st.booleans(), st.integers(0, 7), opt(st.integers(0, 127)), opt(st.integers(0, 255)), st.integers(0, 3), st.booleans(), opt(st.integers(0, 31)))
def test_vp8_descriptor_round_trip(non_ref, start, part, pid, tl0, tid, sync, key):
    d = {"non_reference": non_ref, "start_of_partition": start, "partition_id": part, "picture_id": pid, "tl0picidx": tl0, "temporal_id": tid, "layer_sync": sync, "key_index": key}
    packet = rtp.build_vp8(d) + b"x"
    got = rtp.parse_vp8(packet)
    assert {k: got[k] for k in d} == d and got["size"] == len(packet) - 1


def test_vp8_descriptor_invalid():
    for bad in (b"", b"\x80", b"\x80\x40\x01", b"\x80\x80", b"\x80\x80\x80"):
        with pytest.raises(ValueError):
            rtp.parse_vp8(bad)
    with pytest.raises(ValueError):
        rtp.build_vp8({"tl0picidx": 3})


@settings(max_examples=200, deadline=None)
@given(opt(st.integers(0, 32767)), st.booleans(), st.booleans(), opt(st.integers(0, 7)), st.integers(0, 7), st.lists(st.integers(0, 127), min_size=1, max_size=3), st.booleans())
def test_vp9_descriptor_round_trip(pid, inter, flexible, tid, sid, refs, with_ss):
    ss = {"spatial_layers": 2, "widths": [320, 640], "heights": [180, 360], "groups": [{"temporal_id": 1, "switching_up": True, "refs": [1, 2]}]} if with_ss else None
    d = {"picture_id": pid if not (flexible and inter) else pid or 5, "picture_id_15bit": True, "inter_predicted": inter, "flexible": flexible, "start_of_frame": True, "end_of_frame": False, "temporal_id": tid, "spatial_id": None if tid is None else sid, "ss": ss}
    if flexible and inter:
        d["ref_indices"] = refs
    packet = rtp.build_vp9(d)
    got = rtp.parse_vp9(packet)
    assert got["size"] == len(packet) and got["ss"] == ss
    for k in ("picture_id", "inter_predicted", "flexible", "temporal_id", "spatial_id"):
        assert got[k] == d[k]


@settings(max_examples=50, deadline=None)
@given(st.binary(min_size=1, max_size=3000), st.integers(20, 300))
def test_packetize_and_assemble(frame, mtu):
    for desc, cut, join in (({"picture_id": 7}, rtp.packetize_vp8, rtp.assemble_vp8), ({"picture_id": 7, "temporal_id": 1, "spatial_id": 0, "ss": {"spatial_layers": 1, "widths": [64], "heights": [64], "groups": None}}, rtp.packetize_vp9, rtp.assemble_vp9)):
        packets = cut(desc, frame, mtu)
        assert max(len(p) for p, _ in packets) <= mtu
        assert join([p for p, _ in packets], [m for _, m in packets]) == frame
        if len(packets) > 1:
            with pytest.raises(ValueError):
                join([p for p, _ in packets[1:]], [m for _, m in packets[1:]])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=400), min_size=1, max_size=8))
def test_superframe_round_trip(frames):
    assert rtp.parse_superframe(rtp.pack_superframe(frames)) == frames


def test_superframe_ordinary():
    assert rtp.parse_superframe(b"") == [] and rtp.parse_superframe(b"\x82abc") == []


def test_columns(spark):
    good = rtp.build_vp8({"start_of_partition": True, "picture_id": 9, "temporal_id": 1}) + b"abc"
    key = bytes([0x10 | 0 << 1, 0x02, 0x00, 0x9D, 0x01, 0x2A, 0x40, 0x01, 0xF0, 0x00])
    df = spark.createDataFrame([(1, bytearray(good), bytearray(key)), (2, bytearray(b""), bytearray(b"\x01")), (3, None, None)], "i int, p binary, k binary")
    rows = {r["i"]: r for r in df.select("i", rtp.vp8_descriptor("p").alias("d"), headers.vp8_info(F.col("k")).alias("h"), rtp.superframe_frames("p").alias("s")).collect()}
    assert rows[1]["d"]["picture_id"] == 9 and rows[1]["d"]["tl0picidx"] is None
    assert rows[2]["d"]["size"] is None and rows[3]["d"]["size"] is None
    assert (rows[1]["h"]["key_frame"], rows[1]["h"]["width"], rows[1]["h"]["height"], rows[1]["h"]["show_frame"]) == (True, 320, 240, True)
    assert rows[2]["h"] is None and rows[3]["h"] is None


def test_vp9_header():
    bits = "10" + "00" + "0" + "0" + "1" + "0" + f"{0x498342:024b}" + "001" + "0" + f"{639:016b}" + f"{359:016b}"
    data = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    h = headers.vp9_header(data)
    assert (h["key_frame"], h["show_frame"], h["width"], h["height"], h["refresh_frame_flags"]) == (True, True, 640, 360, 255)
    with pytest.raises(ValueError):
        headers.vp9_header(b"\x00")


def test_sdp(spark):
    texts = ["max-fr=30;max-fs=3600", "max-fr=30", "MAX-FR=30;max-fs=1", "max-fr=0;max-fs=1", "max-fr=1;max-fr=2;max-fs=3", "x", "profile-id=0", "profile-id=2;max-fs=9", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = [(r["v8"], r["v9"], r["p"]) for r in df.orderBy("i").select(sdp.vp8_caps(F.col("t")).alias("v8"), sdp.vp9_caps(F.col("t")).alias("v9"), sdp.is_profile_0(F.col("t")).alias("p")).collect()]
    as_pair = lambda x: None if x is None else (x["max_fr"], x["max_fs"])
    assert [as_pair(r[0]) for r in rows] == [(30, 3600), None, None, None, None, None, None, None, None]
    assert [as_pair(r[1]) for r in rows] == [(30, 3600), (30, 0), (30, 1), None, None, None, (0, 0), (0, 9), (0, 0)]
    assert [r[2] for r in rows] == [True] * 7 + [False, True]
    assert spark.range(1).select(sdp.macroblocks(F.lit(17), F.lit(16))).first()[0] == 2


def test_quality(spark):
    r = np.random.default_rng(1)
    a = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (64, 16, 16)]
    b = [bytes([p[0] ^ 1]) + p[1:] for p in a]
    assert quality.psnr(a, a) == 100.0 and quality.ssim_global(a, a) == pytest.approx(1.0)
    assert quality.psnr(a, b) == pytest.approx(10 * math.log10(255**2 * 96 / 3))
    df = spark.createDataFrame([(*map(bytearray, a), *map(bytearray, b))], ", ".join(f"p{i} binary" for i in range(6)))
    row = df.select(quality.frame_quality(*df.columns).alias("q"), quality.adler32("p0").alias("a")).first()
    assert row["q"]["psnr"] == quality.psnr(a, b) and row["a"] == __import__("zlib").adler32(a[0])
    curve = [(100.0, 30.0), (200.0, 33.0), (400.0, 36.0), (800.0, 38.5)]
    assert quality.bd_rate(curve, curve) == pytest.approx(0, abs=1e-6)
    assert quality.bd_rate(curve, [(r * 1.1, p) for r, p in curve]) == pytest.approx(10, abs=1e-4)
    assert quality.bd_psnr(curve, [(r, p + 1) for r, p in curve]) == pytest.approx(1, abs=1e-6)
    with pytest.raises(ValueError):
        quality.bd_rate(curve[:3], curve)
    points = [("g", "ref", *p) for p in curve] + [("g", "new", r * 1.1, p) for r, p in curve]
    row = quality.bd_deltas(spark.createDataFrame(points, "g string, c string, rate double, psnr double"), "g", "c", "ref").first()
    assert row["c"] == "new" and row["bd_rate"] == pytest.approx(10, abs=1e-4)


def test_allows_frame(spark):
    rows = [
        ("max-fr=30;max-fs=3600", 1280, 720, 30, True, True),
        ("max-fr=30;max-fs=3600", 1280, 720, 31, False, False),
        ("max-fr=30;max-fs=3600", 1281, 720, 30, False, False),
        ("max-fr=30;max-fs=3600", 2720, 16, 30, False, False),  # 170 blocks a side, 169 at most
        ("max-fr=30;max-fs=3600", 2704, 16, 30, True, True),
        ("max-fr=30", 9999, 9999, 30, None, True),
        ("max-fr=30;max-fs=999999999", 16384, 16, 30, None, True),
        ("profile-id=0", 65537, 480, 30, None, None),
        ("profile-id=0", 640, 480, 500, None, True),
        ("max-fr=30;max-fs=0", 640, 480, 30, None, None),
        ("max-fr=30;max-fs=3600", 640, 480, 0, None, None),
        ("max-fr=30;max-fs=3600", 0, 480, 30, None, None),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, w int, h int, fps int, v8 boolean, v9 boolean").orderBy("i")
    size = [F.col(c) for c in ("w", "h", "fps")]
    got = df.select(sdp.vp8_allows_frame(sdp.vp8_caps(F.col("t")), *size), sdp.vp9_allows_frame(sdp.vp9_caps(F.col("t")), *size)).collect()
    assert [tuple(r) for r in got] == [r[4:] for r in rows]


def test_session_descriptions(spark):
    """Scoping by section, port, direction and payload type."""
    from codalake.functions import sdp

    video = "m=video 9 RTP 96\r\na=rtpmap:96 VP8/90000\r\n"
    cases = [
        ("v=0\r\n" + video, True, True, True),
        (video.replace(" 9 ", " 0 "), False, False, False),
        (video.replace(" 9 ", " 00/2 "), False, False, False),
        (video + "a=inactive\r\n", False, False, False),
        ("a=inactive\r\n" + video + "a=sendonly", True, False, True),
        ("a=recvonly\r\n" + video, True, True, False),
        (video.replace("video", "audio"), False, False, False),
        (video.replace("rtpmap:96", "rtpmap:97"), False, False, False),
        ("m=video 9 RTP\r\na=rtpmap:96 VP8/90000\r\n", False, False, False),
        (video + "a=inactive\r\n" + video.replace("96", "100"), True, True, True),
        ("", False, False, False),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, s string").withColumn("m", sdp.media_sections(F.col("s")))
    m = F.col("m")
    got = df.select("i", sdp.vp8_negotiates(m), sdp.vp8_negotiates(m, sdp.RECEIVES), sdp.vp8_negotiates(m, sdp.SENDS)).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == [c[1:] for c in cases]


def test_packets_one_frame_at_a_time(spark):
    """Frames and packets leave a worker in small batches; a frame that lacks a packet is null, and an empty one has none."""
    data = [(k, bytes([k % 256]) * (k * 700 % 9000)) for k in range(1, 400)] + [(0, b""), (1000, None)]
    df = spark.createDataFrame(data, "k bigint, f binary").repartition(3)
    desc = {"picture_id": 5, "picture_id_15bit": True}
    for cut, join in ((lambda f: rtp.packetize_vp8({}, f, 1200), rtp.assemble_vp8), (lambda f: rtp.packetize_vp9(desc, f, 1200), rtp.assemble_vp9)):
        packets = rtp.packet_rows(df, "k", "f", cut)
        want = {k: (f, len(cut(f))) for k, f in data if f}
        assert {r["k"]: (bytes(r["frame"]), r["packets"]) for r in rtp.frame_rows(packets, "k", join).collect()} == want
        broken = {r["k"]: r["frame"] for r in rtp.frame_rows(packets.where("seq > 0 OR k > 9"), "k", join).where("k <= 9").collect()}
        assert broken and set(broken.values()) == {None}
    rows = ((("a", i, b"x" * 1000, True), 1000) for i in range(5000))
    import pyarrow as pa

    schema = pa.schema([("k", pa.string()), ("seq", pa.int32()), ("payload", pa.binary()), ("marker", pa.bool_())])
    sizes = [b.nbytes for b in rtp._batches(rows, schema)]
    assert len(sizes) > 4 and max(sizes) < 2 << 20
