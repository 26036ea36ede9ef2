"""Whitening, importance resampling and mixing against brute force, and on unusual input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("codalake.llm")

from codalake.llm import mixing, queries, resampling, whitening  # noqa: E402
from codalake.llm.common import Scratch  # noqa: E402
from codalake.llm.groups import repeated  # noqa: E402

VECTORS = "vec_id bigint, embedding array<double>"


def held_against_eigh(rows, vectors, k=4):
    good = [(i, v) for i, v in vectors if v]
    x = {i: np.floor(256 * np.array(v)).astype(int) for i, v in good}
    fit = np.unique(np.array(list(x.values())), axis=0)
    mean = fit.mean(axis=0)
    values, q = np.linalg.eigh((fit - mean).T @ (fit - mean) / len(fit))
    assert len(rows) == len(good) * min(k, len(mean))
    for c in range(1, min(k, len(mean)) + 1):
        found = {r["vec_id"]: r for r in rows if r["component"] == c}
        want = {i: (v - mean) @ q[:, -c] / math.sqrt(values[-c]) for i, v in x.items()}
        a, b = (np.array([f[i] for i in sorted(x)]) for f in ({i: r["whitened"] for i, r in found.items()}, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9
        for i, r in found.items():
            assert r["n"] == len(fit) and int(r["deviation"]) == int(((len(fit) * x[i] - fit.sum(axis=0)) ** 2).sum())
            assert r["explained"] == pytest.approx(values[-c] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_against_eigh(spark):
    r = np.random.default_rng(1)
    v = r.standard_normal((400, 30)) * np.linspace(3, 0.5, 30)
    vectors = [(i, x.tolist()) for i, x in enumerate(v)]
    vectors += [(1000 + i, v[7].tolist()) for i in range(300)]  # copies count once
    bad = [(2000, None), (2001, [1.0, None] + [0.0] * 28), (2002, [float("nan")] + [0.0] * 29), (2003, [float("inf")] * 30), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(vectors + bad, VECTORS).repartition(5).withColumns({c: F.lit("x") for c in ("component", "x", "d", "n", "v")})
    held_against_eigh(whitening.whiten(df).collect(), vectors)


def test_whitening_of_many_partitions_meets_in_groups(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PARTS", 1)
    r = np.random.default_rng(2)
    vectors = [(i, x.tolist()) for i, x in enumerate(r.standard_normal((200, 20)) * np.linspace(2, 1, 20))]
    held_against_eigh(whitening.whiten(spark.createDataFrame(vectors, VECTORS).repartition(6)).collect(), vectors)


def test_whitening_of_few_dimensions_and_large_numbers(spark):
    r = np.random.default_rng(3)
    vectors = [(i, x.tolist()) for i, x in enumerate(r.standard_normal((60, 3)) * [1e9, 1e6, 1e3])]
    rows = whitening.whiten(spark.createDataFrame(vectors, VECTORS)).collect()
    x = [[math.floor(256 * c) for c in v] for _, v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == {i: sum((60 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in enumerate(x)}
    assert {r["component"] for r in rows} == {1, 2, 3} and rows[0]["identity_error"] < 1e-4  # eigenvalues from 1e22 to 1e10


def test_whitening_without_variance_and_empty(spark):
    one = spark.createDataFrame([(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])], VECTORS)
    rows = whitening.whiten(one).collect()
    assert len(rows) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in rows} == {(1, 0, None, 0.0)}
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(5)], VECTORS)
    rows = whitening.whiten(flat).collect()
    assert {r["component"] for r in rows if r["whitened"] is not None} == {1} and rows[0]["identity_error"] < 1e-12
    assert whitening.whiten(one.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1e300, -1e300])], VECTORS)).count() == 2


def test_certificate_finds_a_missed_direction(spark):
    r = np.random.default_rng(4)
    x = np.round(r.standard_normal((500, 40)) * 100 * np.concatenate([[9, 8, 7, 6, 5], np.ones(35)])).astype(np.int64)
    fit = spark.createDataFrame([(40, b) for b in whitening.packed(x)], "d int, x binary")
    cov = whitening.Covariance(fit, 40, x.mean(axis=0), 500)
    values, q = whitening.leading(cov, 4)
    assert whitening.certified(cov, values, q)
    v = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0)) / 500
    e, w = np.linalg.eigh(v)
    assert not whitening.certified(cov, e[[-1, -3, -4, -5]], w[:, [-1, -3, -4, -5]])


def test_chebyshev_damps_the_unwanted_part():
    e = np.linspace(0, 1, 11)
    d = np.diag(np.concatenate([e, [2.0]]))
    x = np.ones((12, 1))
    y = np.abs(whitening.chebyshev(lambda q: d @ q, x, d @ x, 1.0, 2.0, 8))
    assert y[-1] == pytest.approx(1) and y[:-1].max() < 1e-5


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute_resample(docs, target, n=1, buckets=10_000, least=20, share=10):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(code(f) for _, t in docs for f in runs(t, n))
    g = Counter(code(f) for _, t in target for f in runs(t, n))
    gain = {b: math.floor(1000 * math.log((g[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(g.values()) + buckets)))) for b in s}
    out = []
    for i, t in docs:
        fs = runs(t, n)
        weight = sum(gain[code(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{i if i is not None else ''}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(t)) >= least])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    place = {id(r): k + 1 for k, r in enumerate(able[: share * len(able) // 100])}
    return sorted(([*r[:4], place.get(id(r))] for r in out), key=str)


def corpus(n):
    r = np.random.default_rng(n)
    vocabulary = ["Zeta", "déjà", "x1", "the", "of", "Ünion", "b-c", "…", "q r"]
    texts = [" ".join(r.choice(vocabulary, r.integers(0, 60))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3]), (None, texts[5]), (n, None), (n + 1, ""), (n + 2, "A" * 5000), (n + 3, "long words here " * 4000)]


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_against_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr(resampling, "PART", 1 << 12)  # so that texts are cut
    docs, target = corpus(300), [(0, "the long union of words"), (1, None), (2, "X1 x1 déjà")]
    a = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).withColumns({c: F.lit("x") for c in ("score", "rank", "n_words", "above", "times")})
    b = spark.createDataFrame(target, "item_id bigint, text string")
    # Workers import the module anew, so the cut is tried in the driver too.
    got = resampling.resample(a, b, n=n, buckets=1000, least_words=5, share_percent=40)
    rows = sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got.collect()), key=str)
    assert rows == brute_resample(docs, target, n, 1000, 5, 40)
    data = [t.encode() if t else None for _, t in docs]
    for k in (1, 2, n):
        sums = [Counter() for _ in data]
        for doc, bucket, _ in resampling.grams(data, k, 1000):
            for d, x in zip(doc.tolist(), bucket.tolist(), strict=True):
                sums[d][x] += 1
        assert sums == [Counter(zlib.crc32(f.encode()) % 1000 for f in runs(t, k)) for _, t in docs]


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame(corpus(30), "doc_id bigint, text string")
    none = docs.limit(0)
    assert resampling.resample(none, docs).count() == 0
    assert resampling.resample(docs, none).count() == 37
    assert resampling.resample(docs.withColumn("text", F.lit(None).cast("string")), docs).where("rank IS NOT NULL").count() == 0


def test_equal_rows_are_repeated_in_blocks(spark):
    df = spark.createDataFrame([(1, 1), (2, 25), (3, 10)], "k int, times bigint")
    got = sorted((r["k"], r["copy"]) for r in repeated(df, "times", "copy", block=10).collect())
    assert got == [(k, c) for k, n in ((1, 1), (2, 25), (3, 10)) for c in range(n)]


def brute_targets(sizes, weights, share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full: set = set()
    while True:
        rest = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        now = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in full and now[s] > most * sizes[s]}
        if not above:
            return now
        full |= above


@pytest.mark.parametrize("seed", range(3))
def test_mixing_meets_its_targets(spark, seed):
    r = np.random.default_rng(seed)
    names = ["b", "a", "é", "Z", "", None, "hot"]
    docs = [(i, None if i % 50 == 0 else " ".join(["w"] * int(r.integers(0, 40))), names[6] if i % 3 else names[int(r.integers(0, 6))]) for i in range(3000)]
    docs += [docs[7]] * 500 + [(None, "a b c", "b"), (9000, "x " * 3000, "a"), (9001, " \t\n\x0b\f\r", "only space")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    got = mixing.mix(df.repartition(4).withColumns({c: F.lit(1) for c in ("size", "copies", "c", "rows")}), [5, 2, 1], block=8).collect()
    again = mixing.mix(df.repartition(7), [5, 2, 1], block=8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = lambda t: len((t or "").split())
    assert Counter((x["doc_id"], x["size"]) for x in got) == Counter((i, size(t)) for i, t, _ in docs)
    sizes: Counter = Counter()
    for _, t, s in docs:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes), [5, 2, 1])
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    source = {i: s for i, _, s in docs}
    taken: Counter = Counter()
    longest: Counter = Counter()
    for x in got:
        s = source[x["doc_id"]]
        assert x["source_size"] == sizes[s] and x["target"] == pytest.approx(want[s], rel=1e-12)
        base = math.floor(want[s] / sizes[s] + 1e-12) if sizes[s] else 0
        assert x["taken"] == x["copies"] * x["size"] and (x["copies"] in (base, min(base + 1, 2)) or not x["size"])
        taken[s] += x["taken"]
        longest[s] = max(longest[s], x["size"])
    for s, n in taken.items():
        assert abs(n - want[s]) <= longest[s] / 2 + 1e-6


def test_mixing_keeps_each_documents_mean(spark):
    """Over many sources of the same sizes a document's mean copies come near its expected ones."""
    docs = [(f"{k}-{i}", "w " * (1 + i % 7), f"{k:03d}") for k in range(300) for i in range(20)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id string, text string, source string"), [1], block=16).collect()
    total: Counter = Counter()
    for r in rows:
        assert r["target"] == 1.5 * r["source_size"]
        total[r["doc_id"].split("-")[1]] += r["copies"]
    off = [n / 300 - 1.5 for n in total.values()]
    assert len(off) == 20 and abs(sum(off)) / 20 < 0.01 and max(map(abs, off)) < 0.12


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.mix(df, [5, 2, 1]).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
    assert mixing.mix(df.limit(0), [5, 2, 1]).count() == 0
    many = spark.range(500).select(F.format_string("s%03d", "id").alias("source"), (F.col("id") + 1).alias("source_size"))
    scratch = Scratch(spark, "test")
    got = {r["source"]: r["target"] for r in mixing.targets(many, [5, 2, 1], 150, 2, scratch).collect()}
    assert got == pytest.approx(brute_targets({f"s{i:03d}": i + 1 for i in range(500)}, [5, 2, 1]))


def test_mixing_runs_no_python(spark):
    """The plan of every job of op13 has DataFrame operations only."""
    plan = queries.op13_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
