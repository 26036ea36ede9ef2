"""Operators over several documents against brute force on small tables, and the queries against their SQL."""

import itertools
import math
import random
from collections import Counter
from pathlib import Path

import pytest

pytest.importorskip("codalake.llm")
import duckdb  # noqa: E402
import numpy as np  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from codalake.llm import decontaminate, groups, hashing, langid, near_dedup, queries, substring_dedup, url_filter  # noqa: E402

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    at = [names.index(c) for c in df.columns]
    assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, name):
    table = "pages" if name.startswith("op3") else "embeddings" if name.startswith("op11") else "documents"
    n = queries.QUERIES[name](spark, SF).count()
    assert n == read(spark, table).count() * (4 if name.startswith("op11") else 1) or name.startswith("op2_")


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if w:
            out[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))}
    return out


def components(rows, k, percent):
    sets = sets_of(rows, k)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i, _ in rows}, sets


def near_table(seed=4):
    """Copies, chains of small edits, near-threshold groups, short texts and plain ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = [None, "", " ", "one", "One", "two words", "two words", "a b c", "A B C", "a b c d"]
    for _ in range(8):
        base = [word() for _ in range(r.randint(40, 120))]
        texts += [" ".join(base)] * 2
        for _ in range(14):
            w = list(base)
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
        for _ in range(6):  # a chain
            base = list(base)
            base[r.randrange(len(base))] = word()
            texts.append(" ".join(base))
    texts += [" ".join(word() for _ in range(60)) for _ in range(40)]
    r.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, k, percent):
    rows = near_table()
    want, sets = components(rows, k, percent)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=percent, shingle=k).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["n_shingles"] == len(sets.get(r["doc_id"], ())) and r["kept"] == (want[r["doc_id"]] == r["doc_id"]) for r in got)


def test_posterior_bounds():
    needed = near_dedup.least_matches(0.85)
    assert needed == sorted(needed) and needed[-1] < 0.85 * near_dedup.BANDS * near_dedup.ROWS
    n, m = near_dedup.BATCH, needed[0]
    below = sum(math.comb(n + 1, j) * 0.85**j * 0.15 ** (n + 1 - j) for j in range(m))
    assert below < near_dedup.MISS
    a = np.zeros((3, 96), np.uint32)
    b = a.copy()
    b[1] = 1
    b[2, ::20] = 1
    assert list(near_dedup.posterior_survivors(a, b, needed)) == [0, 2]


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, r.randint(101, 150)) for _ in range(20)] + [(200 + r.randint(0, 30), 200 + r.randint(0, 30)) for _ in range(25)] + [(7, 7)]
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in groups.components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: y for x, y in root.items() if x in got} and all(root[x] == x for x in root if x not in got)


def test_substring(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(60)]
    rows, planted = [], {}
    for i in range(200):
        parts = [text(r.randint(30, 300))]
        if i < 120:
            parts += [passages[i % 60], text(r.randint(0, 100))]
            planted[i] = i % 60
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.repeated_passages(df).collect()
    assert {x["doc_id"] for x in got} == set(planted)
    for x in got:
        piece = rows[x["doc_id"]][1].encode()[x["start"] : x["end"]].decode()
        assert piece in f" {passages[planted[x['doc_id']]]} " and x["first_ids"] == [planted[x["doc_id"]]]
        assert x["kept"] == (x["doc_id"] < 60)
    left = dict(substring_dedup.without_repeats(df).collect())
    assert all(left[i] == t for i, t in rows if i < 60 or i >= 120) and all(len(left[i]) < len(rows[i][1]) - 150 for i in range(60, 120))


def test_substring_adjacent(spark):
    """Where passages with different first holders are neighbours, each stays in its own first holder."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    whole = text(130)
    at = len(" ".join(whole.split(" ")[:70]))
    p, q, short = whole[:at], whole[at:], text(12)
    # Document 3 begins some words before P's end, so that no chunk of document 2 is without a repeat there.
    rows = [(1, p), (2, whole), (3, " ".join(whole.split(" ")[60:])), (4, f"{text(40)} {short} {text(40)}")]
    shared = text(60)
    rows += [(5, f"{text(40)} {short} {shared}"), (6, f"{text(40)} {short} {shared}")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(substring_dedup.repeated_passages(df).collect())
    assert [(x["doc_id"], x["first_ids"], x["kept"]) for x in got] == [(1, [1], True), (2, [1], False), (2, [2], True), (3, [1, 2], False), (5, [4, 5], True), (6, [4, 5], False)]
    assert got[1]["end"] == got[2]["start"]
    left = dict(substring_dedup.without_repeats(df).collect())
    assert left[1] == p and left[4] == rows[3][1] and left[5] == rows[4][1]
    assert q in left[2] and p[:-60] not in left[2] and len(left[3]) < 60


def test_substring_against_word_windows(spark):
    """The documents reported are those that share 50 words in a row with another one, and each whole passage is found."""
    rows = [(r["doc_id"], r["text"]) for r in read(spark, "documents").collect()]
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijkl") for _ in range(r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    for n in range(40, 62):  # around the least length, in three documents each, twice in one of them
        p = text(n)
        rows += [(10_000 + 10 * n + k, f"{text(30)} {p} {text(20)}" + (f" {p}" if k == 2 else "")) for k in range(3)]
    seen, own = Counter(), {}
    for i, t in rows:
        w = (t or "").split()
        own[i] = {tuple(w[j : j + 50]) for j in range(len(w) - 49)}
        seen.update(own[i])
    want = {i for i, grams in own.items() if any(seen[g] > 1 for g in grams)}
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x["doc_id"] for x in got} == want
    texts = dict(rows)
    for x in got:
        if x["doc_id"] >= 10_000:
            n = x["doc_id"] // 10 - 1000
            found = texts[x["doc_id"]].encode()[x["start"] : x["end"]].decode().split()
            assert substring_dedup.RUN_WORDS <= x["n_words"] <= n and len(found) <= n + 2 and n >= 50


def test_substring_windows_around_chunk():
    words = [f"w{i}" for i in range(120)]
    data = " ".join(words).encode()
    start, end, _, _ = substring_dedup.chunk(data)
    digest = lambda i, n: substring_dedup._hash(" ".join(words[i : i + n]).encode())
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        inside = [w for w in range(120) if a <= data.index(b"w%d" % w) and data.index(b"w%d" % w) + len(b"w%d" % w) <= b]
        if not inside:
            continue
        place = a << 20 | (b - a) << 8
        want = [i for i in range(71) if i <= inside[0] and inside[-1] < i + 50]
        assert sorted(substring_dedup.windows(data, place, 50)) == sorted(digest(i, 50) for i in want)
        few = set(substring_dedup.windows(data, place, 50, 6, 5))
        # Every window contains one of the few shorter ones.
        assert all(any(digest(i + k, 45) in few for k in range(6)) for i in want)


def test_hashes_do_not_collide_by_structure():
    """Words of two letters in Thue-Morse order, which agree under any polynomial modulo 2^64, differ here."""
    a, b = b"a", b"b"
    for _ in range(13):
        a, b = a + b, b + a
    data = b" ".join([a[:n] for n in (1024, 2048, 4096, 8192)] + [b[:n] for n in (1024, 2048, 4096, 8192)])
    found, _ = hashing.word_hashes(data, hashing._SPACE)
    assert len(set(found.tolist())) == 8
    r = random.Random(1)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 100))).encode() for _ in range(5000)})
    found, starts = hashing.word_hashes(b" ".join(words), hashing._SPACE)
    again, _ = hashing.word_hashes(b"  ".join(reversed(words)), hashing._SPACE)
    assert len(set(found.tolist())) == len(words) == len(starts) and found.tolist() == again.tolist()[::-1]


def test_near_dedup_long_words_and_large_groups(spark):
    """Two different very long words, a group of 2,000 near copies, and a passage that 1,500 other documents share."""
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(60)], [word() for _ in range(60)]
    texts = [a, b]
    for _ in range(2000):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = word()
        texts.append(" ".join(w))
    for _ in range(1500):
        texts.append(" ".join([word() for _ in range(r.randint(2, 40))] + passage + [word() for _ in range(r.randint(0, 10))]))
    r.shuffle(texts)
    rows = list(enumerate(texts))
    _, sets = components(rows[:1], 3, 85)
    sets = sets_of(rows, 3)
    code = {g: i for i, g in enumerate(sorted({g for s in sets.values() for g in s}))}
    matrix = np.zeros((len(rows), len(code)), np.float32)
    for i, s in sets.items():
        matrix[i, [code[g] for g in s]] = 1
    both, size = matrix @ matrix.T, matrix.sum(axis=1)
    linked = 100 * both >= 85 * (size[:, None] + size[None] - both)
    want = np.arange(len(rows))
    while True:
        low = np.where(linked, want[None], len(rows)).min(axis=1)
        if (low == want).all():
            break
        want = np.minimum(want, low)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=85, shingle=3).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(want.tolist()))


def test_chunks_resist_shifts():
    r = random.Random(6)
    data = bytes(r.choice(b"abcdefgh ") for _ in range(20_000))
    start, end, words, digest = substring_dedup.chunk(data)
    assert start[0] == 0 and end[-1] == len(data) and (start[1:] == end[:-1]).all() and (end - start).max() <= substring_dedup.MAX_BYTES
    assert words.sum() == len(data.split())
    moved = substring_dedup.chunk(data[:5000] + b"inserted" + data[5000:])[3]
    assert len(set(digest.tolist()) - set(moved.tolist())) <= 8


def brute_hits(text, items, size=10):
    hit, names = set(), set()
    for name, item in items:
        if not item:
            continue
        m = min(size, len(item))
        wins = {tuple(item[i : i + m]) for i in range(len(item) - m + 1)}
        for i in range(len(text) - m + 1):
            if tuple(text[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                names.add(name)
    return len(text), len(hit), sorted(names)


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontaminate(spark, block):
    r = random.Random(8)
    text = lambda n: [r.choice(["aa", "b", "c1", "é"]) for _ in range(n)]
    items = [(i, text(r.choice([0, 1, 4, 10, 12, 25]))) for i in range(14)]
    docs = [(i, text(r.choice([0, 3, 9, 10, 60, 200]))) for i in range(40)] + [(3, text(50))]
    # A lower-case word of another alphabet differs from its upper-case form; punctuation parts words.
    df = spark.createDataFrame([(i, "-".join(t).upper().replace("É", "é")) for i, t in docs], "doc_id int, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items] + [(99, None)], "item_id int, text string")
    got = decontaminate.decontaminate(df, bench, block_windows=block).collect()
    found = sorted((x["doc_id"], x["n_words"], sum(h["end"] - h["start"] for h in x["hits"]), x["item_ids"]) for x in got)
    assert found == sorted((i, *brute_hits(t, [(str(k), v) for k, v in items])) for i, t in docs)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    out = langid.identify(docs.where(langid.held_out()), model, carry=["lang"]).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.98
    assert all(0 <= r["score"] <= 1 and abs(sum(r["shares"]) - 1) < 1e-6 for r in out)


def test_language_score(spark):
    """The score tells a sure answer from a guess: one letter, nonsense, another script, and a sentence."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    score = lambda t: langid.infer(t, model)[1]
    sentence = docs.where("lang = 'en' AND length(text) > 300").orderBy("doc_id").first()["text"][:200]
    assert score("a") < 0.8 and score(sentence) > 0.95
    assert score("xqzv wkjp zzzz qqqq " * 5) < 0.3 and score("привет мир как дела " * 5) < 0.3
    assert langid.infer("12 345", model)[:2] == ("und", 0.0)


def test_mixture_against_a_grid(spark):
    """The shares of two languages against the best of 200 steps of the same likelihood."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    one = {k: " ".join(r["text"] for r in docs.where(F.col("lang") == k).orderBy("doc_id").limit(8).collect()) for k in ("en", "de")}
    for n in (300, 900, 1500):
        lang, _, names, shares = langid.infer(one["en"][:1800] + " " + one["de"][:n], model)
        found = np.bincount(langid.features(one["en"][:1800] + " " + one["de"][:n]), minlength=langid.BUCKETS)
        p, q = (np.exp(model.log_p[model.languages.index(k)]) for k in ("en", "de"))
        grid = np.arange(1, 200) / 200
        value = [float(found @ np.log(x * p + (1 - x) * q)) for x in grid]
        assert names == ["en", "de"] and abs(shares[0] - grid[int(np.argmax(value))]) < 0.02


def test_language_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = langid.fit(docs)
    one = {lang: " ".join(r["text"] for r in docs.where(F.col("lang") == lang).limit(12).collect())[:6000] for lang in ("en", "de", "fr")}
    lang, score, names, shares = langid.infer(one["en"] + " " + one["de"][:3000], model)
    assert lang == "en" and names == ["en", "de"] and 0.55 < score < 0.8
    assert langid.infer(one["fr"], model)[2] == ["fr"]


def test_language_mixture_of_all(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    model = langid.fit(docs)
    assert len(model.languages) >= 4
    one = {lang: " ".join(r["text"] for r in docs.where(F.col("lang") == lang).limit(12).collect())[:3000] for lang in model.languages}
    lang, score, names, shares = langid.infer(" ".join(one.values()), model)
    assert sorted(names) == model.languages and lang == names[0] and score == shares[0] < 1 / 3
    assert all(abs(s - 1 / len(shares)) < 0.08 for s in shares)
    # A language that fills a twentieth of the text counts too.
    few = " ".join(t[: 3000 if i else 500] for i, t in enumerate(one.values()))
    assert sorted(langid.infer(few, model)[2]) == model.languages


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        if rest.startswith("/"):
            path = rest[: min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, None)


def test_urls(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    urls = dict(pages.select("page_id", "url").collect())
    for i, url in urls.items():
        host, path, rule, verdict = brute_url(url)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule)
        assert verdict in (None, rows[i]["verdict"])
    # The mined rules against counting, over all labelled urls.
    judged = pages.select(*[c.alias(n) for c, n in zip(url_filter.host_and_path(F.col("url")), ("host", "path"), strict=True)])
    rule, verdict = url_filter.rule_columns(F.col("host"), F.col("path"), url_filter.RULES)
    labelled = judged.select(url_filter.tokens(F.col("host"), F.col("path")).alias("tokens"), verdict.alias("label")).where("label IS NOT NULL")
    data = [(set(r["tokens"]), r["label"]) for r in labelled.collect()]
    mined = url_filter.mine(labelled)
    assert mined
    for tokens, label, confidence, support in mined:
        all_ = [x for t, x in data if set(tokens) <= t]
        assert Counter(all_)[label] / len(all_) == pytest.approx(confidence) and confidence >= url_filter.MIN_CONFIDENCE
        assert Counter(all_)[label] / len(data) == pytest.approx(support)
    index = url_filter.RuleIndex(mined)
    for tokens, _ in data:
        first = next(((label, c, " ".join(t)) for t, label, c, _ in mined if set(t) <= tokens), None)
        assert index.match(sorted(tokens)) == first


def brute_rules(labelled, rows=10, confidence=0.8, lift=1.1, sources=2):
    """(-confidence, -support, -tokens, tokens, label) of the confirmed rules by precedence: every set of tokens of any url is tried."""
    fit = [x for x in labelled if not x[3]]
    base = Counter(x[1] for x in labelled)
    least = max(rows, math.ceil(url_filter.MIN_SUPPORT * len(fit)))
    often: Counter = Counter()
    for t, label, *_ in fit:
        for k in range(1, len(t) + 1):
            for p in itertools.combinations(sorted(t), k):
                often[p, None] += 1
                often[p, label] += 1
    good = {}
    for (p, label), m in often.items():
        if label is None or m < least or m < confidence * often[p, None]:
            continue
        fits = [x for x in labelled if set(p) <= x[0]]
        out = [x for x in fits if x[3]]
        ok = bool(out) and sum(x[1] == label for x in out) >= confidence * len(out)
        ok = ok and sum(x[1] == label for x in fits) / len(fits) >= lift * base[label] / len(labelled)
        told = []
        for g in {x[2] for x in fits}:
            host, _, path = g.partition("/")
            on_host = any(t == f"h:{host}" or t.startswith("h:") and t.endswith(f".{host}") for t in p)
            if not on_host or {f"p:{x}" for x in path.split("/") if x} <= set(p):
                told.append(g)
        ok = ok and len({x[2] for x in fits if x[2] in told and x[1] == label}) >= sources
        for g in told:
            rest, own = [x[1] == label for x in fits if x[2] in told and x[2] != g], [x[1] == label for x in fits if x[2] == g]
            ok = ok and bool(rest) and sum(rest) >= confidence * len(rest) and sum(own) >= confidence * len(own)
        if ok:
            good[p, label] = (m / often[p, None], m / len(fit))
    kept = [(-c, -s, -len(p), p, label) for (p, label), (c, s) in good.items() if not any(good.get((q, label), (0,))[0] >= c for k in range(1, len(p)) for q in itertools.combinations(p, k))]
    return sorted(kept)


def test_url_rules_left_out(spark):
    """A combination that several given rules tell stands; what they say of a part of their host without its path does not, nor a rule
    that fails on one of them; a longer combination stands where its parts fail."""
    r = random.Random(8)
    rows = []
    for k in range(900):
        # Given rules: net/es/ and net/fr/ block; a.org/x/, b.org/x/ block where the query asks; c.org/ allows.
        source, tokens_, label = r.choice(
            [
                ("net/es/", ["h:net", f"h:n{k % 3}.net", "p:es"], "block"),
                ("net/fr/", ["h:net", f"h:n{k % 3}.net", "p:fr"], "block"),
                ("a.org/x/", ["h:org", "h:a.org", "p:x", "q:ad", "p:y"], "block"),
                ("b.org/x/", ["h:org", "h:b.org", "p:x", "q:ad", "p:y"], "block"),
                ("c.org/", ["h:org", "h:c.org", "p:x"], "allow"),
                ("c.org/", ["h:org", "h:c.org", "p:y", "q:other"], "allow"),
                ("d.org/", ["h:org", "h:d.org", "q:ad"], "allow"),
                ("e.org/", ["h:org", "h:e.org", "q:ad", "p:z"], "allow"),
            ]
        )
        rows.append((tokens_, label, source, k % 5 == 0))
    got = url_filter.learned(spark.createDataFrame(rows, "tokens array<string>, label string, source string, held boolean"))
    assert [(t, x) for t, x, *_ in got] == [(k[3], k[4]) for k in brute_rules([(frozenset(t), *x) for t, *x in rows])]
    assert {("p:x", "q:ad"), ("p:x", "p:y")} <= {t for t, x, *_ in got if x == "block"}
    assert not any(set(t) <= {"h:net", "h:n0.net", "h:n1.net", "h:n2.net", "p:es", "p:fr"} for t, *_ in got)


def test_url_verdicts_against_counting(spark):
    """The verdict of every url, by counting over all labelled urls in plain Python."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path = url_filter.host_and_path(F.col("url"))
    query = url_filter.query_of(F.col("url"))
    rule, verdict = url_filter.rule_columns(host, path, url_filter.RULES)
    held = F.pmod(F.xxhash64(host, path, query), F.lit(5)) == 0
    rows = pages.select("page_id", url_filter.tokens(host, path, query).alias("tokens"), rule.alias("source"), verdict.alias("label"), held.alias("held")).collect()
    labelled = [(frozenset(r["tokens"]), r["label"], r["source"], r["held"]) for r in rows if r["label"] is not None and r["tokens"]]
    kept = brute_rules(labelled)
    got = {r["page_id"]: (r["verdict"], r["mined"]) for r in url_filter.filter_urls(pages).collect()}
    for r in rows:
        first = next((k for k in kept if set(k[3]) <= set(r["tokens"])), None) if r["label"] is None else None
        want = (r["label"] or (first[4] if first else url_filter.DEFAULT), " ".join(first[3]) if first else None)
        assert got[r["page_id"]] == want
    unruled = Counter(got[r["page_id"]][0] for r in rows if r["label"] is None)
    assert unruled["allow"] > 0  # what a single given rule says of its own host does not decide about the others


def test_url_rules_must_hold_elsewhere(spark):
    """A combination that one given rule alone labels, or that fails on held-out rows, is not used."""
    rows = [(["p:en", "h:a.com"], "block", "a.com/en/", k % 5 == 0) for k in range(50)]
    rows += [(["p:x", "h:b.com"], "block", "b.com/x/", k % 5 == 0) for k in range(50)] + [(["p:x", "h:c.org"], "block", "c.org/x/", k % 5 == 0) for k in range(50)]
    rows += [(["p:y", f"h:{h}"], "block" if k % 5 else "allow", f"{h}/", k % 5 == 0) for h in ("d.com", "e.com") for k in range(50)]
    rows += [(["p:z", f"h:f{k % 3}.com"], "allow", f"f{k % 3}.com/", k % 5 == 0) for k in range(300)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, label string, source string, held boolean")
    kept = {r[0] for r in url_filter.confirmed(url_filter.mine(labelled.where("NOT held"), min_rows=10), labelled)}
    assert ("p:x",) in kept and ("p:z",) in kept and not kept & {("p:en",), ("h:a.com",), ("p:y",)}


def test_url_tokens_reach_the_whole_url(spark):
    """Verdicts that depend on a deep subdomain, a late segment, a hyphenated part or a query are mined."""
    r = random.Random(3)
    urls = []
    for i in range(400):
        bad, kind = i % 2 == 0, i // 2 % 5
        host, path, query = f"n{r.randrange(40)}.org", f"/a/b/c{r.randrange(9)}", f"n={r.randrange(1000)}"
        host = f"{'bad' if bad else 'good'}.a.b.c.{host}" if kind == 0 else host
        path += ("/poor/1" if bad else "/fine/2") if kind == 1 else ""
        path += ("/0815" if bad else "/4711") if kind == 2 else ""
        host = f"{'pills' if bad else 'news'}-{r.randrange(10**6)}.{host}" if kind == 3 else host
        query += ("&ad=1" if bad else "&ad=0") if kind == 4 else ""
        host = f"bad.a.b.c.n{i % 3}.org" if bad and kind == 0 else host
        urls.append((i, f"http://{host}{path}?{query}#x", "block" if bad else "allow"))
    df = spark.createDataFrame(urls, "page_id int, url string, label string")
    host, path = url_filter.host_and_path(F.col("url"))
    labelled = df.select(url_filter.tokens(host, path, url_filter.query_of(F.col("url"))).alias("tokens"), "label")
    index = url_filter.RuleIndex(url_filter.mine(labelled, min_support=0.02))
    needed = {("p:poor",), ("p:fine",), ("p:0815",), ("p:4711",), ("w:pills",), ("w:news",), ("q:ad=1",), ("q:ad=0",), ("h:bad.a.b.c.n0.org",)}
    assert needed <= {tuple(x[0]) for x in index.rules}
    for tokens in ("p:x p:y p:z p:poor", "h:org w:pills", "h:c.n0.org h:bad.a.b.c.n0.org", "p:a q:ad=1"):
        assert index.match(tokens.split())[0] == "block"


def test_growth_against_counting(spark):
    """All rules of up to four tokens, over rows with tokens that always come together and nested ones."""
    r = random.Random(4)
    data = []
    for _ in range(300):
        t = {x for x in "abcdefg" if r.random() < 0.5}
        t |= {f"{x}{k}" for x in t & set("ab") for k in range(9)}  # without pruning, 2 ** 18 sets
        if t:
            data.append((sorted(t), "block" if len(t & set("cde")) > 1 or "g" in t and r.random() < 0.9 else "allow"))
    mined = url_filter.mine(spark.createDataFrame(data, "tokens array<string>, label string"), 0.02, 0.8)
    sets, rules = [(set(t), x) for t, x in data], {}
    names = [*"abcdefg", *(f"{x}{k}" for x in "ab" for k in range(9))]
    for k in range(1, 5):
        for p in itertools.combinations(names, k):
            c = Counter(x for t, x in sets if t >= set(p))
            for label, m in c.items():
                if m >= 0.02 * len(data) and m >= 0.8 * c.total() and not any(rules.get((q, label), (0,))[0] >= m / c.total() for j in range(1, k) for q in itertools.combinations(p, j)):
                    rules[p, label] = (m / c.total(), m / len(data))
    got = {(tuple(sorted(t, key=names.index)), label): (confidence, support) for t, label, confidence, support in mined}
    assert len(rules) > 10 and got == rules


def test_langid_scans_all_splits(spark, tmp_path):
    """The stage that reads the texts has a task for each of the table's splits."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs.repartition(90).write.parquet(f"{tmp_path}/d")
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    for k in before:
        spark.conf.set(k, "1k")
    try:
        table = spark.read.parquet(f"{tmp_path}/d")
        splits = table.rdd.getNumPartitions()
        spark.sparkContext.setJobGroup("langid-fit", "fit")
        langid.fit(table)
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(i) for j in tracker.getJobIdsForGroup("langid-fit") for i in tracker.getJobInfo(j).stageIds]
        sizes = [s.numTasks for s in stages if s]
        assert splits > 64 and sizes.count(splits) >= 2  # the labels' scan and the texts'
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def omissions(n, seed=3):
    """Documents that each lack a random tenth of 40 blocks of ten words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    blocks = [" ".join(word() for _ in range(10)) for _ in range(40)]
    return [(i, " ".join(b for j, b in enumerate(blocks) if j not in lacks)) for i in range(n) for lacks in [set(r.sample(range(40), 4))]]


def test_near_dedup_of_random_omissions(spark, monkeypatch):
    """The last step's pairs do not grow with the square of such a group, and the components are those of brute force."""
    made = []
    plain = near_dedup._prefix_pairs

    def counted(rare, labels, percent, scratch):
        pairs = plain(rare, labels, percent, scratch)
        made[-1] = pairs.count()
        return pairs

    monkeypatch.setattr(near_dedup, "_prefix_pairs", counted)
    for n in (300, 1200):
        made.append(0)
        rows = omissions(n)
        got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), percent=85, shingle=3).collect()
        if n == 300:
            assert {r["doc_id"]: r["component_id"] for r in got} == components(rows, 3, 85)[0]
        else:
            sets = near_sets(rows)
            assert {r["doc_id"]: r["component_id"] for r in got} == sets
    assert made[1] <= max(made[0], 300) * 4**1.2


def near_sets(rows, k=3, percent=85):
    """components() of many similar documents, by a matrix of their shingles."""
    sets = sets_of(rows, k)
    number: dict = {}
    for s in sets.values():
        for x in s:
            number.setdefault(x, len(number))
    m = np.zeros((len(rows), len(number)), np.float32)
    for i, s in sets.items():
        m[i, [number[x] for x in s]] = 1
    both, size = m @ m.T, m.sum(axis=1)
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    root = np.arange(len(rows))
    while True:
        new = np.where(link, root[None, :], len(rows)).min(axis=1)
        if (new == root).all():
            return dict(enumerate(root.tolist()))
        root = new
