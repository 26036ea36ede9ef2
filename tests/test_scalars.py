import numpy as np
from pyspark.sql import functions as F

from codalake.functions import formats
from codalake.functions import scalars as s
from codalake.sources import synthetic


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_arithmetic(spark):
    big = F.lit(s.HIGH)
    v = lambda x: F.lit(x).cast("bigint")
    assert one(spark, s.saturating_add(big, v(1)), s.saturating_sub(F.lit(s.LOW), v(1)), s.checked_mul(big, v(2)), s.percent_of(v(-7), v(50)), s.percent_of(big, v(200))) == (s.HIGH, s.LOW, None, -3, s.HIGH)
    assert one(spark, s.macroblock_rows(v(17)), s.align(v(17), v(16)), s.size_bits(v(-1)), s.size_bits(v(3))) == (2, 32, 0, 24)
    assert tuple(one(spark, s.chroma(v(5), v(3)))[0]) == (3, 2, 27)
    assert one(spark, s.bits_per_frame(v(1_000_000), v(1), v(30), v(1)), s.clock_ticks(v(7), v(30)), s.frame_of_elapsed(v(100_000_000), 30)) == (33333, 21000, 2)
    assert one(spark, s.pct_delta(v(5), v(0)), s.is_overrun(v(21), v(10)), s.is_overrun(v(20), v(10)), s.clamp_to_level(v(900), v(1000)), s.clamp_to_level(v(9), v(0))) == (500.0, True, False, 800, 9)
    assert (s.lcm(4, 6), s.lcm(0, 3), s.split_bitrate(101, [40, 60])) == (12, 0, [40, 61])


def test_layers(spark):
    r = F.array(*[F.lit(x).cast("bigint") for x in (40, 60, 100)])
    t = F.lit(100).cast("bigint")
    assert one(spark, s.layer_bitrates(t, 3), s.valid_layer_bitrates(r, t), s.valid_layer_bitrates(r, F.lit(99)), s.layer_differences(r)) == ([40, 60, 100], True, False, [40, 20, 40])
    rows = s.temporal_patterns(spark).groupBy("mode").agg(F.max("layer").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) == 13 and {x["mode"]: (x["m"], x["n"]) for x in rows}["five_layers"] == (4, 16)
    for layers, decimators in s.TEMPORAL_PATTERNS.values():
        for k, d in enumerate(decimators):
            assert sum(x <= k for x in layers) * d == len(layers)


def test_quantizers(spark):
    from codalake.functions import quantizers as q

    for table, top in ((q.VP8_INDEX, 127), (q.VP9_INDEX, 255)):
        assert len(table) == 64 and table == sorted(table) and table[-1] == top
        rows = spark.range(top + 1).select(q.to_public(F.col("id"), table).alias("p"), q.to_index(q.to_public(F.col("id"), table), table).alias("i"), "id").collect()
        assert all(r["i"] >= r["id"] and (r["p"] == 0 or table[r["p"] - 1] < r["id"]) for r in rows)
    assert one(spark, q.to_index(F.lit(-3), q.VP8_INDEX), q.to_index(F.lit(99), q.VP9_INDEX)) == (0, 255)


def test_frames(spark):
    from codalake.operators import aggregates as a

    df = spark.createDataFrame([(1, 900, 10), (1, 900, 10), (2, 900, 800), (2, 900, 10)], "f int, r int, i int")
    assert {x["f"]: x["promotes"] for x in a.scene_cuts(df, ["f"], "r", "i", 500, 800).collect()} == {1: True, 2: False}
    rows = [(0, 0, ["last"], ["last"]), (1, 1, ["last"], ["golden"]), (2, 1, ["last", "golden"], []), (3, 2, ["last", "golden"], [])]
    df = spark.createDataFrame([(1, *r) for r in rows], "s int, i int, layer int, rd array<string>, wr array<string>")
    got = a.layer_sync(df, ["s"], ["i"], "layer", "rd", "wr", ["last", "golden"]).orderBy("i").collect()
    assert [r["sync"] for r in got] == [False, True, False, True]
    kinds = spark.createDataFrame([("mode_match_pct",), ("hist_l1",), ("q_mean",)], "n string").select(a.metric_kind(F.col("n")))
    assert [r[0] for r in kinds.collect()] == ["gap_pp", "gap_raw", "value"]


def test_greatest_divisor_of_large_numbers(spark):
    """Neighbours of the Fibonacci row take Euclid's rule the most steps: more than 64."""
    a, b = 1, 1
    while a + b < 1 << 63:
        a, b = b, a + b
    rows = [(b, a), (a, b), (0, 5), (5, 0), (3 * 2**60, 2**61), (None, 3)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a bigint, b bigint")
    got = [r[0] for r in df.orderBy("i").select(s.greatest_divisor(F.col("a"), F.col("b"))).collect()]
    assert got == [1, 1, 5, 5, 2**60, None]


def test_figures_up_to_a_unit(spark):
    df = spark.createDataFrame([(0,), (999,), (5_000_000,), (1_000_000_007,), (3 << 30,)], "n bigint")
    texts = lambda c: [r[0] for r in df.select(c).collect()]
    assert texts(formats.duration(F.col("n"), "ms")) == ["-", "999 ns", "5.00 ms", "1000.00 ms", "3221.23 ms"]
    assert texts(formats.duration(F.col("n"))) == ["-", "999 ns", "5.00 ms", "1.00 s", "3.22 s"]
    assert texts(formats.byte_size(F.col("n"), "MiB")) == ["0 B", "999 B", "4.77 MiB", "953.67 MiB", "3072.00 MiB"]
    assert texts(formats.byte_size(F.col("n")))[-1] == "3.00 GiB"


def test_many_frames(spark):
    """Frames made for many rows at once are those that are made one by one, and as many calls as batches make them."""
    df = spark.range(300).withColumn("k", F.col("id") * 7 - 20)
    for width, height in ((5, 3), (12, 8)):
        got = synthetic.frames_of(df, "k", width, height, "panning").orderBy("id").collect()
        assert [tuple(bytes(r[c]) for c in "yuv") for r in got] == [synthetic.panning(width, height, r["k"]) for r in got]
    assert [p.shape for p in synthetic.panning_many(5, 3, np.arange(7))] == [(7, 15), (7, 6), (7, 6)]


def test_bounds_without_exceptions(spark):
    """At the bounds of 64 bits sums, products and bits are those of Python's whole numbers; nothing is tried and caught."""
    edge = [0, 1, -1, 2, -2, 3037000500, -3037000500, s.HIGH, s.LOW, s.HIGH - 1, s.LOW + 1, s.HIGH // 2, s.LOW // 2, s.HIGH // 3 + 1]
    df = spark.createDataFrame([(a, b) for a in edge for b in edge] + [(None, 1), (1, None)], "a bigint, b bigint")
    a, b = F.col("a"), F.col("b")
    cut = lambda x: min(max(x, s.LOW), s.HIGH)
    out = df.select("a", "b", s.saturating_add(a, b), s.saturating_sub(a, b), s.checked_mul(a, b))
    for x, y, add, sub, mul in out.collect():
        assert (add, sub, mul) == ((None, None, None) if x is None or y is None else (cut(x + y), cut(x - y), x * y if s.LOW <= x * y <= s.HIGH else None)), (x, y)
    assert "try_" not in out._jdf.queryExecution().optimizedPlan().toString()
    bits = spark.createDataFrame([(s.HIGH, 1, 3, 1), (s.HIGH, 7, 100, 1), (10**6, 1001, 30000, 1), (5, 1, 2, 1), (0, 1, 2, 1), (-4, 1, 2, 1), (5, 1, 0, 1), (5, 1, -2, 1)], "w bigint, n bigint, d bigint, t bigint")
    want = [(w * n * t + d // 2) // d if w * n * t > 0 and d > 0 else 0 for w, n, d, t in [tuple(r) for r in bits.collect()]]
    assert [r[0] for r in bits.select(s.bits_per_frame(*map(F.col, "wndt"))).collect()] == want
