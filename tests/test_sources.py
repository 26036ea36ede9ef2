import json
import struct

import pytest

from codalake.operators import traces
from codalake.sources import ivf, synthetic, text, webm


def test_ivf(spark, tmp_path):
    frames = [bytes([0x10, 1, 2]), bytes([0x11]), b"\x10" * 50]
    (tmp_path / "a.ivf").write_bytes(ivf.build("VP80", 64, 48, frames))
    (tmp_path / "b.ivf").write_bytes(ivf.build("VP90", 64, 48, frames[:1], pts=[2**63]))
    df = ivf.read_ivf(spark, str(tmp_path))
    rows = sorted((r["path"][-5:], r["idx"], int(r["pts"]), bytes(r["payload"])) for r in df.collect())
    assert rows == [("a.ivf", i, i, f) for i, f in enumerate(frames)] + [("b.ivf", 0, 2**63, frames[0])]
    sums = {r["path"][-5:]: (r["frames"], r["bytes"], r["key_frames"]) for r in ivf.sizes(df).collect()}
    assert sums["a.ivf"] == (3, 54, 2)
    again = ivf.build_files(df, "path").collect()
    assert {bytes(r["content"]) for r in again} == {ivf.build("VP80", 64, 48, frames), ivf.build("VP90", 64, 48, frames[:1])}


def test_ivf_broken():
    whole = ivf.build("VP80", 64, 48, [b"abc"])
    for bad in (whole[:20], b"XXXX" + whole[4:], ivf.build("XXXX", 64, 48, []), ivf.build("VP80", 0, 48, [])):
        with pytest.raises(ValueError):
            ivf.parse_header(bad)
    for cut in (whole[:-1], whole[:40]):
        with pytest.raises(ValueError):
            list(ivf.frames(cut))


def element(name: int, body: bytes) -> bytes:
    size = (0x10000000 | len(body)).to_bytes(4, "big")
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + size + body


def test_webm(spark, tmp_path):
    track = element(webm.TRACKS, element(webm.TRACK, element(webm.NUMBER, b"\x01") + element(webm.CODEC, b"V_VP9")))
    head = b"\x81\x00\x00"
    blocks = [
        element(webm.SIMPLE, head + b"\x00" + b"one"),
        element(webm.SIMPLE, head + b"\x04" + b"\x02aabbcc"),
        element(webm.GROUP, element(webm.BLOCK, head + b"\x02" + b"\x01" + b"\x02" + b"xx" + b"yyy")),
        element(webm.SIMPLE, head + b"\x06" + b"\x02" + b"\x82" + b"\xc0" + b"pp" + b"qqq" + b"r"),
        element(webm.SIMPLE, b"\x82\x00\x00\x00other track"),
    ]
    data = element(webm.SEGMENT, track + element(webm.CLUSTER, b"".join(blocks)))
    want = [b"one", b"aa", b"bb", b"cc", b"xx", b"yyy", b"pp", b"qqq", b"r"]
    assert webm.vp9_packets(data) == want
    (tmp_path / "a.webm").write_bytes(data)
    rows = webm.read_webm(spark, str(tmp_path)).orderBy("idx").collect()
    assert [bytes(r["payload"]) for r in rows] == want
    with pytest.raises(ValueError):
        webm.vp9_packets(data[:-3])


def test_traces(spark, tmp_path):
    a = [{"type": "frame", "q": 1, "x": None}, {"type": "rate", "q": 5}, {"type": "frame", "q": 7, "name": "k"}, {"type": "frame"}]
    b = [{"type": "frame", "q": 1.0}, {"type": "frame", "q": 5}, {"type": "frame", "q": 9, "name": "k"}]
    for name, rows in (("a", a), ("b", b)):
        (tmp_path / f"{name}.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    left, right = (text.trace_rows(spark, str(tmp_path / f"{n}.jsonl")) for n in "ab")
    got = [tuple(r) for r in traces.compare_traces(left, right).orderBy("row_index", "field").collect()]
    assert got == [
        (0, "field", "x", "null", None),
        (1, "type_mismatch", "type", "rate", "frame"),
        (2, "field", "q", "7", "9"),
        (3, "missing_right", None, None, None),
    ]
    near = traces.compare_traces(left, right, {"q": 2.0}).where("kind = 'field'").collect()
    assert [r["field"] for r in near] == ["x"]
    assert traces.of_type(left, "frame").count() == 3
    values = spark.createDataFrame([('{"a": 1.5}',), ('{"a": true}',), ('{"a": "3"}',), ("{}",)], "j string").selectExpr("parse_json(j) AS row")
    assert [r[0] for r in values.select(traces.trace_float("row", "a")).collect()] == [1.5, 0.0, 0.0, 0.0]
    kept = traces.project(left, {"frame": ["q"]}).orderBy("line_no").collect()
    assert [(r["line_no"], r["fields"]) for r in kept] == [(0, {"q": "1"}), (2, {"q": "7"})]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\nnot json\n')
    assert text.trace_rows(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception, match="MALFORMED"):
        text.trace_rows(spark, str(tmp_path / "bad.jsonl")).collect()


def test_scrapes(spark, tmp_path):
    (tmp_path / "m.txt").write_text("n:1 psnr:30.5 z\nnothing\nn:2 psnr:31 psnr:9\n")
    assert [r["metric"] for r in text.metric_values(spark, str(tmp_path / "m.txt"), "psnr").orderBy("line_no").collect()] == [30.5, 31.0]
    (tmp_path / "s.txt").write_text("intro\nFor layer#: 0\nrate 5\nrate 6\nFor layer#: 1\nrate 7\n")
    rows = text.layer_sections(spark, str(tmp_path / "s.txt")).orderBy("line_no").collect()
    assert [(r["layer"], r["value"]) for r in rows] == [(0, "rate 5"), (0, "rate 6"), (1, "rate 7")]
    df = spark.createDataFrame([("q=3 f=1",), ("q=3",), ("q=3 f=1 z=2",)], "value string")
    assert [r[0] is not None for r in df.select(text.key_values(df["value"], ["q", "f"])).collect()] == [True, False, False]
    (tmp_path / "st.bin").write_bytes(struct.pack("<4d", 1, 2, 3, 4))
    assert [tuple(r)[1:] for r in text.first_pass_stats(spark, str(tmp_path / "st.bin"), ["a", "b"]).orderBy("idx").collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0)]
    (tmp_path / "base.json").write_text('{"fixtures": {"f1": {"m": 2}}}')
    assert [(r["fixture"], r["metric"]) for r in text.baselines(spark, str(tmp_path / "base.json")).collect()] == [("f1", "m")]


def test_synthetic(spark):
    r = synthetic.synthetic_frames(spark, 6, 4, 3).orderBy("idx").collect()[2]
    assert bytes(r["y"])[7] == 32 + ((3 * 1 + 5 * 1 + 14) & 191) and len(r["u"]) == 6


def test_synthetic_kinds():
    y, u, v = synthetic.checker(40, 20, 5)
    at = lambda r, c: y[r * 40 + c]
    assert (len(y), len(u), len(v)) == (800, 200, 200)
    assert all(at(r, c) == (48 if (((c + 5) // 16) ^ ((r + 2) // 16)) % 2 == 0 else 208) for r in range(20) for c in range(40))
    assert {(a, b) for a, b in zip(u, v, strict=True)} == {(112, 144), (144, 112)}
    y, u, v = synthetic.panning(5, 3, 7)
    wave = lambda x, p: (x % p if x % p < p // 2 else p - x % p) * 255 // (p // 2)
    assert list(y) == [min(255, 64 + wave(c + 14 + r + 7, 256) // 4 + wave(c + 14, 64) // 4 + wave(r + 7, 64) // 4) for r in range(3) for c in range(5)]
    assert list(u) == [128 + int((wave(2 * c + 14, 128) - 128) / 8) for _ in range(2) for c in range(3)]
    assert list(v) == [128 + int((wave(2 * r + 7, 128) - 128) / 8) for r in range(2) for _ in range(3)]


def test_seed_literals():
    good = {rb'"a\x00\n\"\\"': b'a\x00\n"\\', rb'"\u00e9\U0001F600\377\a"': "é😀".encode() + b"\xff\x07", b"`raw\\n`": b"raw\\n", b'""': b""}
    for literal, want in good.items():
        assert text.unquoted(literal) == want
    for bad in (b"abc", b'"', b'"a"b"', rb'"\q"', rb'"\xZZ"', rb'"\ud800"', b'"a\nb"', b"`a`b`", rb'"a\"'):
        with pytest.raises(ValueError):
            text.unquoted(bad)


def test_seed_archives(spark, tmp_path):
    """Many seeds make few files; an archive is cut wherever its splits end."""
    rows = [(f"d/{i}", ('"' + "\\x41" * (i % 40) + ("\\n-- no mark --\\n" if i % 3 else "\r\\x00") + '"')) for i in range(500)]
    want = {(name, text.unquoted(literal.encode())) for name, literal in rows}
    path = str(tmp_path / "x")
    text.write_seed_archives(spark.createDataFrame(rows, "name string, literal string").coalesce(2), path)
    assert len(list((tmp_path / "x").glob("part-*"))) == 2
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "997"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = text.archived_seeds(spark, path)
            assert size == before or got.rdd.getNumPartitions() > 20
            assert sorted((r["name"], bytes(r["seed"])) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a").write_text('go test fuzz v1\n[]byte("\\x00\\x01b")\n')
    assert bytes(text.fuzz_seeds(spark, str(tmp_path / "one")).first()["seed"]) == b"\0\1b"
