"""Keyed processors on running streams, against their batch forms."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from codalake.operators import folds, walks
from codalake.streaming import processors


def source(spark, path, schema, batches):
    """A stream whose micro-batches are these lists of rows."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i:03d}")
        time.sleep(1.1)  # files are taken by their time
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def drained(spark, df, path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def until(spark, df, path, name, enough, seconds=40):
    """The rows of a stream that goes on, when there are enough."""
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{path}/ck").trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + seconds
        while time.time() < end and spark.table(name).count() < enough:
            time.sleep(0.3)
        time.sleep(1.5)
        return spark.table(name).collect()
    finally:
        q.stop()


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


def test_wait_by_event_time(spark, tmp_path):
    """Ready at once, ready later, timeout by the watermark, and late polls that change nothing."""
    schema = "k string, ts timestamp, ready boolean, n int"
    batches = [
        [("a", at(0), False, 1), ("b", at(1), True, 2), ("c", at(2), False, 3)],
        [("a", at(3), False, 4), ("c", at(4), True, 5), ("b", at(5), True, 6)],
        [("d", at(60), False, 7)],
        [("d", at(120), True, 8)],
        [("a", at(121), True, 9), ("d", at(50), True, 10)],
    ]
    df = source(spark, tmp_path / "in", schema, batches).withWatermark("ts", "1 second")
    rows = drained(spark, processors.wait_stream(df, "k", "ready", "n", 10_000, "ts"), tmp_path, "waited")
    assert sorted(tuple(r) for r in rows) == [("a", "timeout", 4), ("b", "ready", 2), ("c", "ready", 5), ("d", "timeout", 7)]
    flat = spark.createDataFrame([r for b in batches for r in b if r[3] != 10], schema)
    batch = walks.wait_until(flat, ["k"], "ts", "ready", "n", F.expr("INTERVAL 10 SECONDS"))
    assert sorted((r["k"], r["outcome"], r["n"]) for r in batch.collect()) == sorted(tuple(r) for r in rows)


def test_wait_by_the_clock(spark, tmp_path):
    df = source(spark, tmp_path / "in", "k string, ready boolean, n int", [[("a", False, 1), ("b", True, 2)]])
    rows = until(spark, processors.wait_stream(df, "k", "ready", "n", 1500), tmp_path, "clock", 2)
    assert sorted(tuple(r) for r in rows) == [("a", "timeout", 1), ("b", "ready", 2)]


def queue_calls(seed, n=40):
    r = random.Random(seed)
    return [(k, i, r.random() < 0.3) for k in ("x", "y") for i in range(n)]


def test_look_ahead(spark, tmp_path):
    """A stream over three micro-batches gives what the batch form gives, and that a plain queue."""
    calls = queue_calls(1)
    df = source(spark, tmp_path / "in", "k string, i int, flush boolean", [[c for c in calls if c[1] // 14 == j] for j in range(3)])
    rows = drained(spark, processors.look_ahead_stream(df, "k", "i", "flush", 4), tmp_path, "ahead")
    want = []
    for k in ("x", "y"):
        held: list[int] = []
        for _, i, flush in (c for c in calls if c[0] == k):
            if not flush:
                held.append(i)
            if held and (flush or len(held) == 4):
                want.append((k, i, held.pop(0), flush))
    assert sorted(tuple(r) for r in rows) == sorted(want)
    batch = folds.look_ahead(spark.createDataFrame(calls, "k string, i int, flush boolean"), "k", ["i"], "flush", 4).where("frame IS NOT NULL").collect()
    frames = {k: [i for key, i, f in calls if key == k and not f] for k in ("x", "y")}
    assert sorted((r["k"], r["i"], frames[r["k"]][r["frame"] - 1], r["drained"]) for r in batch) == sorted(want)


def test_look_ahead_drains_one_at_each_expiry(spark, tmp_path):
    df = source(spark, tmp_path / "in", "k string, i int, flush boolean", [[("x", i, False) for i in range(5)]])
    rows = until(spark, processors.look_ahead_stream(df, "k", "i", "flush", 3, idle_ms=700), tmp_path, "idle", 5)
    assert [(r["call"], r["frame"], r["drained"]) for r in rows] == [(2, 0, False), (3, 1, False), (4, 2, False), (None, 3, True), (None, 4, True)]


CALLS = "k string, i int, call string, dropped boolean, key boolean, layer int, layers int, signature string, error string"


def packetizer_calls():
    c = lambda i, call="packetize", dropped=False, key=False, layer=0, layers=3, signature=None, error=None: ("s", i, call, dropped, key, layer, layers, signature, error)
    return [
        c(0, key=True),
        c(1, "size"),
        c(2),
        c(3, "size", dropped=True, layer=2, signature="p"),
        c(4, dropped=True, layer=2, signature="p"),
        c(5, error="small"),
        c(6, dropped=True, layer=2, signature="p"),
        c(7, "size"),
        c(8, dropped=True, layer=2, signature="p"),
        c(9, dropped=True, layer=1, signature="q"),
        c(10),
        c(11, key=True, layer=1),
        c(12, key=True, error="bad"),
        c(13, key=True),
        c(14, "unsent"),
        c(15),
        c(16, "encoded_unsent"),
        c(17, key=True),
        c(18, layers=1, dropped=True, signature="z"),
    ]


def test_packetizer_state(spark, tmp_path):
    """Ids, latch and refusals by hand; the stream over three micro-batches gives the same."""
    want = [
        ("sent", 0, False), ("sized", None, False), ("sent", 1, False),
        ("dropped", 2, False), ("dropped", None, False), ("small", None, False), ("dropped", None, False),
        ("sized", None, False), ("dropped", 3, False),
        ("dropped", 4, True), ("refused", None, True), ("refused", None, True), ("bad", None, True), ("sent", 5, False),
        ("withheld", None, True), ("refused", None, True), ("withheld", 6, True), ("sent", 7, False), ("dropped", 8, True),
    ]
    calls = packetizer_calls()
    out = folds.packetizer(spark.createDataFrame(calls, CALLS), "k", ["i"]).orderBy("i").collect()
    assert [(r["outcome"], r["picture_id"], r["key_needed"]) for r in out] == want
    df = source(spark, tmp_path / "in", CALLS, [[c for c in calls if c[1] // 7 == j] for j in range(3)])
    rows = drained(spark, processors.packetizer_stream(df, "k", "i"), tmp_path, "packets")
    assert [tuple(r)[2:] for r in sorted(rows, key=lambda r: r["i"])] == want


def test_packetizer_ids_wrap():
    s = folds.PacketizerState(picture=(1 << 15) - 1)
    assert s.step("packetize", False, True, 0, 1, None, None) == ("sent", (1 << 15) - 1, False)
    assert s.picture == 0


def test_assemble_stream(spark, tmp_path):
    """Fragments out of order, twice and over micro-batches; one frame that stays incomplete."""
    batches = [
        [("f", 2, b"c", True), ("f", 0, b"a", False), ("g", 0, b"x", False)],
        [("f", 0, b"A", False), ("h", 0, b"z", True)],
        [("f", 1, b"b", False), ("g", 2, b"y", True)],
    ]
    df = source(spark, tmp_path / "in", "k string, seq int, payload binary, marker boolean", batches)
    rows = until(spark, processors.assemble_stream(df, "k", "seq", "payload", "marker", 3_600_000), tmp_path, "frames", 2)
    assert sorted((r["k"], bytes(r["payload"])) for r in rows) == [("f", b"Abc"), ("h", b"z")]


@pytest.mark.parametrize("empty", [True, False])
def test_wait_until_edges(spark, empty):
    df = spark.createDataFrame([(None, at(0), None, 1), (None, at(1), True, 2)], "k string, ts timestamp, ready boolean, n int")
    rows = walks.wait_until(df.limit(0) if empty else df, ["k"], "ts", "ready", "n", F.expr("INTERVAL 10 SECONDS")).collect()
    assert [tuple(r) for r in rows] == ([] if empty else [(None, "ready", 2)])
