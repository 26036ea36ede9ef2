import numpy as np
import pytest
from pyspark.sql import functions as F

from codalake.operators import aggregates, compare, folds, ordered, packets, sets
from codalake.streaming import stateful


def test_last_row_and_keyed(spark):
    a = spark.createDataFrame([(1, 5.0), (1, 6.0), (2, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 9.0, 1), (1, 5.0, 2), (3, 1.0, 1)], "k int, v double, n int")
    r = compare.keyed_compare(a, b, ["k"], "v", ["n"]).first()
    assert (r["n_left"], r["n_right"], r["matched"], r["left_only"], r["right_only"], r["max_abs_delta"]) == (3, 2, 2, 1, 1, 1.0)
    empty = compare.keyed_compare(a.limit(0), b.limit(0), ["k"], "v").first()
    assert empty["match_pct"] == 0.0 and empty["max_abs_delta"] == 0.0


def test_fold_state_ends_with_stream(spark):
    rows = [(s, i, 100.0) for s in range(5) for i in range(50)]
    df = spark.createDataFrame(rows, "s int, i int, b double").repartition(3)
    out = {(r["s"], r["i"]): (r["level"], r["dropped"]) for r in folds.drop_automaton(df, "s", ["i"], "b", 60.0, 500.0, 300.0, 50).collect()}
    for i in range(50):
        assert len({out[s, i] for s in range(5)}) == 1
    assert any(d for _, d in out.values()) and not out[0, 0][1]
    got = [r["rolling"] for r in folds.rolling_average(df.where("s = 0"), "s", ["i"], "b").orderBy("i").collect()]
    assert got == [100] * 50


def test_bucket_is_a_fold(spark):
    r = np.random.default_rng(2)
    rows = [(s, i, float(b)) for s in range(3) for i, b in enumerate(r.integers(0, 200, 40))]
    df = spark.createDataFrame(rows, "s int, i int, b double")
    got = {(x["s"], x["i"]): x["level"] for x in ordered.leaky_bucket(df, ["s"], ["i"], F.lit(90.0), F.col("b"), 100.0, 300.0).collect()}
    for s in range(3):
        level = 100.0
        for _, i, b in [x for x in rows if x[0] == s]:
            level = min(level + 90, 300) - b
            assert abs(got[s, i] - level) < 1e-9


def test_controllers(spark):
    df = spark.createDataFrame([(1, i, t, 10.0, w) for i, (t, w) in enumerate([(25.0, 3), (25.0, 3), (5.0, 3), (5.0, 3), (25.0, 2)])], "s int, i int, t double, d double, w long")
    assert [r["cap"] for r in folds.cap_controller(df, "s", ["i"], "t", "d", "w", 2, 2).orderBy("i").collect()] == [3, 2, 2, 3, 2]
    df = spark.createDataFrame([(1, i, *x) for i, x in enumerate([(0, False, 0), (1, True, 7), (1, True, 7), (1, False, 0)])], "s int, i int, layer long, dropped boolean, sig long")
    assert [(r["picture_id"], r["tl0"]) for r in folds.picture_ids(df, "s", ["i"], "layer", "dropped", "sig").orderBy("i").collect()] == [(0, 0), (1, 0), (None, 0), (2, 0)]
    grid = [0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([(1, 4, 3, grid[:12]), (2, 3, 4, [1] * 5 + [0] + [1] * 6), (3, 2, 2, [1, 0, 0, 0])], "k int, n int, m int, g array<int>")
    out = {r["k"]: r["smoothed"] for r in folds.skin_smoothing(df, "k", "n", "m", "g").collect()}
    assert out == {1: grid[:12], 2: [1] * 12, 3: [1, 0, 0, 0]}
    assert list(folds.kmeans_1d([1, 1, 1, 9, 9], 2)) == [1, 9] and not len(folds.kmeans_1d([]))


def test_running_streak_and_delay(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([True, True, False, True])], "s int, i int, b boolean")
    assert [r["n"] for r in ordered.running_streak(df, ["s"], ["i"], F.col("b"), "n").orderBy("i").collect()] == [1, 2, 0, 1]
    assert [r["out"] and r["out"]["i"] for r in ordered.delayed(df, ["s"], ["i"], 2, "out").orderBy("i").collect()] == [2, 3, None, None]


def test_packets(spark):
    df = spark.createDataFrame([(1, bytearray(b"abcdefg")), (2, bytearray(b""))], "k int, p binary")
    cut = packets.packetize(df, "p", 3, 2)
    assert [bytes(r["fragment"]) for r in cut.orderBy("seq").collect()] == [b"ab", b"cde", b"fg"]
    assert bytes(packets.assemble(cut, ["k"]).first()["payload"]) == b"abcdefg"
    assert packets.assemble(cut.where("seq <> 1"), ["k"]).first()["payload"] is None
    assert packets.assemble(cut.unionByName(cut.where("seq = 0")), ["k"]).first()["payload"] is None


def test_sets(spark):
    df = spark.createDataFrame([([1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(sets.jaccard(F.col("a"), F.col("b"))).collect()] == [1 / 3, 1.0]


def test_bucket_stream(spark, tmp_path):
    rows = [(s, i, float(50 + 7 * i)) for s in range(3) for i in range(10)]
    for half in (0, 1):
        spark.createDataFrame([x for x in rows if (x[1] >= 5) == bool(half)], "s int, i int, b double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("s int, i int, b double").parquet(str(tmp_path / "in"))
    q = stateful.bucket_stream(source, "s", "i", "b", 60.0, 100.0, 200.0).writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = ordered.leaky_bucket(spark.createDataFrame(rows, "s int, i int, b double"), ["s"], ["i"], F.lit(60.0), F.col("b"), 100.0, 200.0)
    assert {tuple(r) for r in spark.table("bucket").select("s", "i", "level").collect()} == {tuple(r) for r in want.select("s", "i", "level").collect()}


def test_interval_stream(spark, tmp_path):
    spark.sql("SELECT 1 AS k, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id * 20) AS ts, CAST(id AS double) AS v FROM range(30)").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k int, ts timestamp, v double").parquet(str(tmp_path / "in"))
    q = stateful.interval_stream(source, ["k"], "ts", "v", "1 minute", "1 minute").writeStream.format("memory").queryName("intervals").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("intervals").orderBy("start").collect()
    assert [(r["n"], r["low"], r["high"]) for r in rows[:2]] == [(3, 0.0, 2.0), (3, 3.0, 5.0)]


def test_decimation(spark):
    """Marks 600, 400, 150, 75 by hand: the factor rises by steps, key rows are kept, the cap holds."""
    bits = [700, 400, 400, 0, 400, 0, 0, 0, 0, 0]
    rows = [(1, i, b, i == 4) for i, b in enumerate(bits)] + [(2, i, 0, False) for i in range(6)]
    df = spark.createDataFrame(rows, "s int, i int, b int, k boolean").repartition(3)
    out = folds.decimation(df, "s", ["i"], "b", "k", 100, 1250, 1000, 60).orderBy("s", "i").collect()
    want = [
        (400, 0, False),  # 1000 + 100 - 700
        (100, 0, False),  # 400 is not below 400
        (-200, 1, False),
        (-100, 2, True),
        (-400, 3, False),  # a key row
        (-300, 3, True),
        (-200, 3, True),
        (-100, 3, True),
        (0, 3, False),
        (100, 3, True),
    ]
    assert [(r["level"], r["factor"], r["dropped"]) for r in out if r["s"] == 1] == want
    assert [r["level"] for r in out if r["s"] == 2] == [1100, 1200, 1250, 1250, 1250, 1250]
    off = folds.decimation(df, "s", ["i"], "b", "k", 100, 1250, 1000, 60, allowed=False)
    assert off.where("dropped OR factor > 0").count() == 0


def test_tile_schedule(spark):
    def brute(sizes, workers):
        at = list(range(len(sizes)))
        if len(at) <= 1 or workers <= 1:
            return at
        at.sort(key=lambda i: -sizes[i])
        if workers >= len(at):
            return at[1:] + at[:1]
        a, b = 0, len(at) - 2
        while a < b:
            at[a], at[b] = at[b], at[a]
            a, b = a + 2, b - 2
        return at

    r = np.random.default_rng(3)
    frames = {n: r.integers(0, 6, n).tolist() for n in range(1, 14)}
    df = spark.createDataFrame([(n, i, s) for n, v in frames.items() for i, s in enumerate(v)], "f int, i int, s int")
    for workers in (1, 2, 4, 8):
        got = ordered.tile_schedule(df, "f", ["i"], "s", workers).orderBy("f", "place").collect()
        for n, sizes in frames.items():
            assert [x["i"] for x in got if x["f"] == n] == brute(sizes, workers)


def test_fold_null_keys(spark):
    """A null stream key is one stream, as any other key is."""
    rows = [(None, 1, 100), (None, 2, 200), (None, 3, 300), (7, 1, 100), (7, 2, 200), (7, 3, 300)]
    out = folds.rolling_average(spark.createDataFrame(rows, "k int, i int, v int"), "k", ["i"], "v").collect()
    assert {(r["k"], r["i"]): r["rolling"] for r in out} == {(k, i): v for k in (None, 7) for i, v in ((1, 100), (2, 125), (3, 169))}


def test_order_statistics(spark):
    """Against sorting, with ties, null groups and a group of one."""
    import random

    r = random.Random(3)
    groups = {"a": [r.randint(0, 9) for _ in range(101)], "b": [r.random() for _ in range(40)], None: [5.0, 5.0, 1.0], "c": [2.0]}
    df = spark.createDataFrame([(g, float(v), i) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, v double, i int")
    got = {x["g"]: x for x in aggregates.percentiles(df, ["g"], "v", [1, 50, 95, 100]).collect()}
    middle = {x["g"]: x["median"] for x in aggregates.medians(df, ["g"], "v").collect()}
    row = {x["g"]: (x["v"], x["i"]) for x in aggregates.upper_median_row(df, ["g"], ["v", "i"]).collect()}
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert [got[g][f"p{p}"] for p in (1, 50, 95, 100)] == [s[max(1, -(-n * p // 100)) - 1] for p in (1, 50, 95, 100)]
        assert middle[g] == (s[(n + 1) // 2 - 1] + s[n // 2]) / 2
        if g is not None:
            assert row[g] == sorted((float(v), i) for i, v in enumerate(vs))[n // 2]
    assert aggregates.percentiles(df.limit(0), ["g"], "v", [50]).count() == 0


def test_compare_transitions(spark):
    kind = "s int, i int, d boolean, q int, t int"
    a = [(1, 0, False, 5, 1), (1, 1, True, 6, 2), (1, 2, False, 7, None), (2, 0, False, 1, 1)]
    b = [(1, 0, False, 9, 1), (1, 1, False, 6, 3), (1, 2, False, 4, 3), (2, 0, False, 1, 1)]
    run = lambda x, y: compare.compare_transitions(spark.createDataFrame(x, kind), spark.createDataFrame(y, kind), ["s"], ["i"], "i", "d", ["d"], ["t"], ["q"]).orderBy("s").collect()
    assert [tuple(r) for r in run(a, b)] == [(1, 3, 1, 1, 4), (2, 1, 0, 0, 0)]
    for x, y, what in ((a, b[1:], "unequal length|indexes differ"), (a[:-1], b, "unequal length"), (a, [*b[:2], (1, 5, False, 4, 3), b[3]], "indexes differ")):
        with pytest.raises(Exception, match=what):
            run(x, y)
