"""Container files as data sources: ranges, headers only, commit and abort, discovery, baselines; and layouts of bytes."""

import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from codalake.functions import layouts, quality
from codalake.operators import keyframes, packets
from codalake.sources import baselines, containers, ivf, webm

FRAMES = "s string, idx int, payload binary"


def frames(spark, rows):
    return spark.createDataFrame(rows, FRAMES).withColumns({"fourcc": F.lit("VP80"), "width": F.lit(4), "height": F.lit(2)})


def test_ivf_source_round_trip(spark, tmp_path):
    r = random.Random(1)
    rows = [(s, i, r.randbytes(r.randint(0, 60))) for s in ("a/b", "z", None, "é ?") for i in range(50)]
    path = str(tmp_path / "x")
    containers.write_ivf(frames(spark, rows).repartition(5), path, "s")
    assert sorted(os.listdir(path)) == sorted(["s-a%2Fb.ivf", "s-z.ivf", "null.ivf", "s-%C3%A9%20%3F.ivf"])
    want = sorted((i, p) for _, i, p in rows)
    for size in (64, 500, 1 << 20):
        df = containers.read_ivf(spark, path, range_bytes=size)
        assert sorted((x["idx"], bytes(x["payload"])) for x in df.collect()) == want
    assert containers.read_ivf(spark, path, range_bytes=64).rdd.getNumPartitions() > 50
    heads = containers.read_ivf(spark, path, payload=False)
    assert "payload" not in heads.columns and heads.count() == 200
    data = (tmp_path / "x" / "s-z.ivf").read_bytes()
    assert ivf.parse_header(data)["frame_count"] == 50
    for x in heads.where(F.col("path").endswith("s-z.ivf")).collect():
        assert data[x["offset"] : x["offset"] + x["size"]] == next(p for s, i, p in rows if s == "z" and i == x["idx"])


def test_ivf_source_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: its headers are read without its payloads, and it is cut into ranges."""
    path = str(tmp_path / "big.ivf")
    with open(path, "wb") as f:
        f.write(struct.pack(ivf.HEADER, b"DKIF", 0, 32, b"VP90", 8, 8, 30, 1, 9, 0))
        for i in range(9):
            f.write(struct.pack(ivf.FRAME, 300 << 20, i) + bytes([i]))
            f.seek((300 << 20) - 2, 1)
            f.write(b"e")
    row = containers.summary(containers.read_ivf(spark, path, payload=False)).first()
    assert (row["frames"], row["bytes"], row["key_frames"]) == (9, 9 * (300 << 20), 5)
    assert containers.read_ivf(spark, path).rdd.getNumPartitions() == 9


def test_ivf_source_errors(spark, tmp_path):
    path = tmp_path / "x"
    containers.write_ivf(frames(spark, [("a", 0, b"abc"), ("a", 1, b"defg")]), str(path), "s")
    good = (path / "s-a.ivf").read_bytes()
    for cut, what in ((good[:-1], "truncated frame"), (good[:40], "truncated frame header"), (good[:20], "too short"), (b"X" + good[1:], "no IVF header")):
        (path / "s-a.ivf").write_bytes(cut)
        with pytest.raises(Exception, match=what):
            containers.read_ivf(spark, str(path)).collect()
    with pytest.raises(Exception, match="nowhere"):
        containers.read_ivf(spark, str(tmp_path / "nowhere")).collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert containers.read_ivf(spark, str(empty)).count() == 0


def test_writers_leave_nothing_half_done(spark, tmp_path):
    path = tmp_path / "x"
    rows = [("a", 0, b"abc"), ("b", 0, b"x")]
    containers.write_ivf(frames(spark, rows), str(path), "s")
    with pytest.raises(Exception, match="holds s-a.ivf already"):
        containers.write_ivf(frames(spark, [("a", 0, b"new"), ("c", 0, b"new")]), str(path), "s")
    assert sorted(os.listdir(path)) == ["s-a.ivf", "s-b.ivf"] and b"abc" in (path / "s-a.ivf").read_bytes()
    bad = frames(spark, [("d", 0, b"fine"), ("e", 0, None)])
    with pytest.raises(Exception):
        containers.write_ivf(bad, str(path), "s")
    assert sorted(os.listdir(path)) == ["s-a.ivf", "s-b.ivf"]
    containers.write_ivf(frames(spark, [("a", 0, b"new")]), str(path), "s", "overwrite")
    assert os.listdir(path) == ["s-a.ivf"] and b"new" in (path / "s-a.ivf").read_bytes()
    containers.write_ivf(frames(spark, []), str(tmp_path / "none"), "s")
    assert os.listdir(tmp_path / "none") == []


def test_raw_sink(spark, tmp_path):
    rows = [("a", i, 3, 3, bytes(range(12)), b"abXcdX", b"efXghX", 4, 3, 3) for i in range(2)]
    df = spark.createDataFrame(rows, "s string, idx int, width int, height int, y binary, u binary, v binary, y_stride int, u_stride int, v_stride int")
    containers.write_i420(df, str(tmp_path / "x"), "s")
    assert (tmp_path / "x" / "s-a.i420").read_bytes() == 2 * (bytes([0, 1, 2, 4, 5, 6, 8, 9, 10]) + b"abcdefgh")
    with pytest.raises(Exception, match="smaller than its size"):
        containers.write_i420(df.withColumn("u_stride", F.lit(1)), str(tmp_path / "y"), "s")


def test_discovery(spark, tmp_path):
    head = lambda four, magic=b"DKIF", w=8: struct.pack(ivf.HEADER, magic, 0, 32, four, w, 8, 30, 1, 0, 0)
    (tmp_path / "d" / "deep").mkdir(parents=True)
    files = {"b.IVF": head(b"VP80"), "deep/a.ivf": head(b"VP80"), "c.ivf": head(b"VP90"), "other.ivf": head(b"AV01"), "invalid-x.ivf": head(b"VP80"), "invalid-y.ivf": head(b"VP90"), "note.txt": b"short", "vp91-2-x.webm": b"x", "VP90-1.webm": b"x"}
    for name, data in files.items():
        (tmp_path / "d" / name).write_bytes(data)
    root = str(tmp_path / "d")
    names = lambda df: [r["path"].split("/d/")[1] for r in df.collect()]
    assert names(containers.find_ivf(spark, root, "VP8")) == ["b.IVF", "deep/a.ivf"]
    assert names(containers.find_ivf(spark, root, "VP8", limit=1)) == ["b.IVF"] and names(containers.find_ivf(spark, root, "VP8", limit=9)) == ["b.IVF", "deep/a.ivf"]
    assert names(containers.find_ivf(spark, root, "VP9")) == ["c.ivf"]
    assert names(containers.find_ivf(spark, root, "VP8", invalid=True)) == ["invalid-x.ivf"]
    assert names(containers.find_ivf(spark, root, "VP9", invalid=True)) == ["invalid-x.ivf", "invalid-y.ivf"]
    assert names(containers.find_ivf(spark, f"{root}/c.ivf", "VP9") .withColumn("path", F.concat(F.lit("/d/"), F.element_at(F.split("path", "/"), -1)))) == ["c.ivf"]
    assert names(containers.find_webm(spark, root, profiles=[1, 2, 3])) == ["vp91-2-x.webm"]
    assert names(containers.find_webm(spark, root, names=["VP90-1.webm"])) == ["VP90-1.webm"]
    (tmp_path / "d" / "z.ivf").write_bytes(b"DKIF")
    for codec in ("VP8", "VP9"):
        with pytest.raises(Exception, match="not valid IVF data"):
            containers.find_ivf(spark, root, codec).collect()


def test_baselines(spark, tmp_path):
    path = str(tmp_path / "deep" / "b.json")
    one = spark.createDataFrame([("f", "b", 2.0), ("f", "a", 1.5), ("e", "x", None)], "fixture string, metric string, value double")
    got, wrote = baselines.read_or_write_baseline(one, path)
    assert wrote and sorted(map(tuple, got.collect()), key=str) == [("e", "x", None), ("f", "a", 1.5), ("f", "b", 2.0)]
    text = open(path).read()
    assert text.endswith("}\n") and text.index('"e"') < text.index('"f"') and text.index('"a"') < text.index('"b"') and '\n  "fixtures"' in text
    other = one.withColumn("value", F.lit(9.0))
    got, wrote = baselines.read_or_write_baseline(other, path)
    assert not wrote and {r["value"] for r in got.collect()} == {None, 1.5, 2.0}
    got, wrote = baselines.read_or_write_baseline(other, path, update=True)
    assert wrote and {r["value"] for r in got.collect()} == {9.0}
    open(path, "w").write("{broken")
    with pytest.raises(Exception):
        baselines.read_or_write_baseline(other, path)[0].collect()
    with pytest.raises(ValueError, match="twice"):
        baselines.write_baseline(one.unionByName(one), path)


def test_partition_layout(spark):
    size = lambda n: n.to_bytes(3, "little")
    packet = b"HHH" + b"11" + size(2) + size(3) + size(1) + b"aabbbcdddd"
    cases = [(packet, 3, 2, 2), (packet[:-4], 3, 2, 2), (packet[:9], 3, 2, 2), (packet, 3, 99, 2), (packet, 99, 0, 0), (packet, 3, 2, 4), (b"HHH" + b"11" + size(9) + b"ab", 3, 2, 1), (b"HHHrest", 3, 0, 0), (b"HHH", 3, 0, 0), (None, 3, 0, 0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p binary, h int, f int, lg int")

    def run(conceal):
        out = df.withColumn("x", layouts.partition_layout(F.col("p"), F.col("h"), F.col("f"), F.col("lg"), conceal)).orderBy("i").collect()
        return [r["x"] and ((r["x"]["first"]["off"], r["x"]["first"]["len"]), [(t["off"], t["len"]) for t in r["x"]["tokens"]]) for r in out]

    whole = ((3, 2), [(14, 2), (16, 3), (19, 1), (20, 4)])
    assert run(False) == [whole, None, None, None, None, None, None, ((3, 0), [(3, 4)]), None, None]
    assert run(True) == [
        whole,
        ((3, 2), [(14, 2), (16, 3), (19, 1)]),
        ((3, 2), [(9, 0)]),
        ((3, len(packet) - 3), [(len(packet), 0)]),
        None,
        None,
        ((3, 2), [(8, 2)]),
        ((3, 0), [(3, 4)]),
        ((3, 0), []),
        None,
    ]


def test_cursor(spark):
    df = spark.createDataFrame([(b"",), (b"\x05",), (bytes(range(17)),)], "d binary")
    got = [tuple(r) for r in df.select(layouts.option_label(F.col("d")), layouts.layer_label(F.col("d")), *[layouts.cursor_byte(F.col("d"), k) for k in (0, 16, 17)]).collect()]
    assert got == [
        ("options_empty", "multires_cpu0_t0", 0, 0, 0),
        ("options_w32h32_vbr_best_cpum3_tokens2_er", "svc3tl_mode6_cpum8_t2_er1", 5, 5, 5),
        ("options_w16h32_cq_rt_cpu0_tokens2_noer", "multires_cpum3_t0_er1", 0, 16, 0),
    ]


def test_layer_fragments(spark):
    rows = [(1, [(3, "abcdefghij"), (4, "xyz")]), (2, []), (3, [(3, "")]), (4, [(9, "a")]), (5, [(3, None)]), (6, None)]
    df = spark.createDataFrame(rows, "k int, layers array<struct<head:int,payload:string>>")
    got = [tuple(r) for r in packets.layer_fragments(df, "layers", 6).orderBy("k", "seq").select("k", "seq", "layer", "fragment", "start_of_frame", "end_of_frame", "marker").collect()]
    assert got == [(1, 0, 0, "abc", True, False, False), (1, 1, 0, "defg", False, False, False), (1, 2, 0, "hij", False, True, False), (1, 3, 1, "xy", True, False, False), (1, 4, 1, "z", False, True, True)]
    assert [r[0] for r in df.orderBy("k").select(packets.layer_packets("layers", 6)).collect()] == [5, None, None, None, None, None]


def test_sampled_differences(spark):
    r = np.random.default_rng(1)
    rows, want = [], []
    for k, h in enumerate([320, 200, 64, 192, 0]):
        a, b = (r.integers(0, 256, (h, 256), dtype=np.uint8) for _ in range(2))
        if k == 0:
            b[64:128, 64:128] = a[64:128, 64:128]
        sads = [int(np.abs(a[y : y + 64, x : x + 64].astype(int) - b[y : y + 64, x : x + 64]).sum()) for y in range(64, h - 64, 64) for x in range(64, 192, 64) if (y // 64) % 2 == (x // 64) % 2 and y + 64 <= h and y // 64 < -(-h // 64) - 1]
        rows.append((k, a.tobytes(), b.tobytes()))
        want.append((k, sum(sads) // len(sads) if sads else None, sum(s == 0 for s in sads) if sads else None, len(sads)))
    rows += [(9, b"abc", b"ab"), (10, None, b"ab")]
    want += [(9, None, None, 0), (10, None, None, 0)]
    got = quality.sampled_differences(spark.createDataFrame(rows, "k int, a binary, b binary"), "a", "b", 256)
    assert sorted(tuple(x) for x in got.select("k", "average", "zeros", "samples").collect()) == want
    assert want[0][2] == 1 and got.limit(0).count() == 0


STATS = ["pcnt_inter", "pcnt_second_ref", "pcnt_neutral", "pcnt_motion", "mvr_abs", "mvc_abs", "intra_error", "coded_error"]


def plain_cut(rows, at, whole):
    """The test for a key frame by loops over dictionaries."""
    if at < 1 or at + 1 >= len(rows):
        return False
    safe = lambda v: v - 1e-6 if v < 0 else v + 1e-6
    last, this, after = rows[at - 1 : at + 2]
    if max(this["pcnt_second_ref"], after["pcnt_second_ref"]) >= 0.1:
        return False
    moved = any(abs(last[c] - this[c]) / safe(this[c]) > 0.4 for c in ("coded_error", "intra_error")) or after["intra_error"] / safe(after["coded_error"]) > 3.5
    if not (this["pcnt_inter"] < 0.05 or (this["pcnt_inter"] - this["pcnt_neutral"] < 0.25 and this["intra_error"] / safe(this["coded_error"]) < 2.5 and moved)):
        return False
    boost, decay, seen = 0.0, 1.0, 0
    ahead = rows[at + 1 : at + 17]
    for seen, x in enumerate(ahead):
        score = min(1.4 * x["intra_error"] / safe(x["coded_error"]), 14.0)
        decay *= x["pcnt_inter"] if x["pcnt_inter"] > 0.85 else (0.85 + x["pcnt_inter"]) / 2
        gain, boost = decay * score, boost + decay * score
        if x["pcnt_inter"] < 0.05 or score < 1.5 or (x["pcnt_inter"] - x["pcnt_neutral"] < 0.2 and score < 3) or gain < 0.5 or x["intra_error"] < 200:
            break
    else:
        seen = len(ahead) if whole or len(ahead) == 16 else len(ahead) - 1
    return boost > 5 and seen > 3


def plain_frames(rows, start, most):
    rate = lambda x: min(x["pcnt_inter"], 1 - x["pcnt_motion"] / 20, (lambda d: 0.0 if d > 1 else 1 - d)(float(np.hypot(x["mvr_abs"] * x["pcnt_motion"], x["mvc_abs"] * x["pcnt_motion"])) / 250))
    n, ring = 1, [1.0] * 8
    for i in range(len(rows) - start - 1):
        this, after = start + 1 + i, start + 2 + i
        if after >= len(rows):
            n += 1
            continue
        if i >= 4 and plain_cut(rows, this, False):
            break
        ring[i % 8] = rate(rows[after])
        ahead = rows[after + 1 : after + 1 + most - i] if most > i else []
        if i > 4 and rate(rows[after]) >= 0.999 and float(np.prod(ring)) < 0.9 and most > i and len(ahead) == most - i and all(rate(x) >= 0.999 for x in ahead):
            break
        n += 1
        if n >= 2 * most:
            break
    return n // 2 if n > most else n


def test_key_frame_walks(spark):
    r = random.Random(6)
    streams = {}
    for s, length in enumerate([1, 2, 3, 9, 150, 260]):
        rows = []
        for _ in range(length):
            still = r.random() < 0.6
            rows.append({"pcnt_inter": 1.0 if still else r.choice([0.0, 0.0, 0.6, 0.9, 0.9]), "pcnt_second_ref": r.choice([0.0] * 9 + [0.2]), "pcnt_neutral": r.choice([0.0, 0.2]), "pcnt_motion": 0.0 if still else r.random(), "mvr_abs": r.random() * 300, "mvc_abs": r.random() * 10, "intra_error": r.choice([100.0, 900.0] + [4000.0] * 8), "coded_error": r.choice([200.0, 300.0, 900.0, 0.0])})
        streams[s] = rows
    df = spark.createDataFrame([(s, i, *(x[c] for c in STATS)) for s, rows in streams.items() for i, x in enumerate(rows)], "s int, i int, " + ", ".join(f"{c} double" for c in STATS)).repartition(3)
    for whole in (False, True):
        got = {(x["s"], x["i"]): x["cut"] for x in keyframes.scene_cuts(df, ["s"], ["i"], "cut", whole).collect()}
        assert got == {(s, i): plain_cut(rows, i, whole) for s, rows in streams.items() for i in range(len(rows))} and any(got.values())
    for most in (6, 10):
        got = {(x["s"], x["i"]): x["n"] for x in keyframes.frames_to_key(df, ["s"], ["i"], most, "n").collect()}
        assert got == {(s, i): plain_frames(rows, i, most) for s, rows in streams.items() for i in range(len(rows))}
    assert {x["n"] for x in keyframes.frames_to_key(df.where("s = 3"), ["s"], ["i"], 0, "n").collect()} == set(range(1, 10))


def element(name, body, unknown=False):
    size = b"\x01" + b"\xff" * 7 if unknown else (0x10000000 | len(body)).to_bytes(4, "big")
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size + body


def webm_file(seed, unknown=False, track=1):
    """Clusters of blocks with all four lacings, of two tracks."""
    r = random.Random(seed)
    packets, clusters = [], b""
    for _ in range(12):
        body = element(0xE7, b"\x00")
        for _ in range(r.randint(0, 6)):
            kind = r.randrange(4)
            n = r.randint(1, 4) if kind else 1
            size = r.randint(1, 30)
            own = [r.randbytes(size if kind == 2 else r.randint(1, 300)) for _ in range(n)]
            sizes = b""
            if kind == 1:
                sizes = b"".join(b"\xff" * (len(x) // 255) + bytes([len(x) % 255]) for x in own[:-1])
            elif kind == 3 and n > 1:
                sizes = (0x4000 | len(own[0])).to_bytes(2, "big") + b"".join((0x4000 | (len(y) - len(x) + 0x1FFF)).to_bytes(2, "big") for x, y in zip(own, own[1:-1], strict=False))
            mine = r.random() < 0.8
            data = bytes([0x80 | (track if mine else track + 1), 0, 0, kind << 1]) + (bytes([n - 1]) + sizes if kind else b"") + b"".join(own)
            body += element(webm.SIMPLE, data) if r.random() < 0.5 else element(webm.GROUP, element(webm.BLOCK, data))
            packets += own if mine else []
        clusters += element(webm.CLUSTER, body, unknown)
    tracks = element(webm.TRACKS, element(webm.TRACK, element(webm.NUMBER, bytes([track])) + element(webm.CODEC, b"V_VP9")))
    return element(0x1A45DFA3, b"head") + element(webm.SEGMENT, tracks + clusters, unknown), packets


def test_webm_source(spark, tmp_path):
    want = {}
    for k, unknown in enumerate((False, True)):
        data, packets = webm_file(k, unknown, 1 + k)
        assert packets and webm.vp9_packets(data) == packets
        (tmp_path / f"{k}.webm").write_bytes(data)
        want[f"{k}.webm"] = packets
    for size in (1, 700, 1 << 20):
        df = containers.read_webm(spark, str(tmp_path), range_bytes=size)
        rows = sorted((r["path"][-6:], r["idx"], bytes(r["payload"])) for r in df.collect())
        assert rows == [(name, i, p) for name, packets in want.items() for i, p in enumerate(packets)]
    assert containers.read_webm(spark, str(tmp_path), range_bytes=700).rdd.getNumPartitions() > 4
    good = (tmp_path / "0.webm").read_bytes()
    (tmp_path / "1.webm").unlink()
    for bad, what in ((good[:-3], "beyond its parent"), (good.replace(b"V_VP9", b"V_VP8"), "no VP9 track")):
        (tmp_path / "0.webm").write_bytes(bad)
        with pytest.raises(Exception, match=what):
            containers.read_webm(spark, str(tmp_path)).collect()


def test_many_small_files_need_few_tasks_and_no_planning(spark, tmp_path, monkeypatch):
    """However small the ranges are, tasks hold many of them, and the planner opens no file that is less than a task's share."""
    rows = [(f"{i:04d}", k, bytes([k]) * 40) for i in range(600) for k in range(6)]
    path = str(tmp_path / "x")
    containers.write_ivf(frames(spark, rows), path, "s")
    df = containers.read_ivf(spark, path, range_bytes=64)
    assert df.rdd.getNumPartitions() <= 1024  # one for each range before: 3,600
    assert sorted((r["path"][-8:-4], r["idx"], bytes(r["payload"])) for r in df.collect()) == rows
    (tmp_path / "w").mkdir()
    data, packets = webm_file(3)
    for i in range(300):
        (tmp_path / "w" / f"{i:03d}.webm").write_bytes(data)
    df = containers.read_webm(spark, str(tmp_path / "w"), range_bytes=100)
    assert df.rdd.getNumPartitions() <= 300  # one for each range of blocks before: thousands
    assert sorted((r["path"][-8:-5], r["idx"], bytes(r["payload"])) for r in df.collect()) == [(f"{i:03d}", k, p) for i in range(300) for k, p in enumerate(packets)]
    opened = []
    plain = containers.Blocks.__init__
    monkeypatch.setattr(containers.Blocks, "__init__", lambda self, path, block: (opened.append(path), plain(self, path, block))[1])
    schema = spark.createDataFrame([], containers.ivf.SCHEMA).schema
    options = {"path": path, "rangeBytes": "64"}
    monkeypatch.setattr(containers, "TASKS", 64)
    parts = containers.IvfReader(schema, options).partitions()
    assert len(parts) <= 600 and not opened
    assert len(containers.WebmReader(schema, {"path": str(tmp_path / "w"), "rangeBytes": "100"}).partitions()) <= 300 and not opened
