"""run() against a brute-force version of its stages."""

import hashlib

import pytest

pytest.importorskip("codalake.llm")
pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from codalake.llm import decontaminate, langid, queries  # noqa: E402
from test_corpus import brute_hits, components  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = langid.fit(spark.read.parquet(f"{SF}/documents.parquet").where(~langid.held_out()))
    kept = {}
    for i, r in sorted(rows.items()):
        lang, score, *_ = langid.infer(r["text"], model)
        if lang != "und" and score >= pipeline.LEAST_SCORE:
            kept[i] = r["text"]
    last = {t: i for i, t in sorted(kept.items())}
    kept = {i: t for t, i in last.items()}
    comp, _ = components(sorted(kept.items()), 5, 80)
    kept = {i: t for i, t in kept.items() if comp[i] == i}
    items = [(str(r["item_id"]), decontaminate.words(r["text"].encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not brute_hits(decontaminate.words(t.encode()), items)[1]}
    coder = Tokenizer.from_file(queries.tokenizer_path())
    coder.no_truncation()
    coder.no_padding()
    got = {r["doc_id"]: r for r in pipeline.run(spark, SF).collect()}
    assert set(got) == set(kept)
    for i, t in kept.items():
        assert got[i]["ids"] == coder.encode(t, add_special_tokens=False).ids
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
        assert (got[i]["lang"], got[i]["source"], got[i]["n_tokens"]) == (rows[i]["lang"], rows[i]["source"], len(got[i]["ids"]))


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars int")


def test_shared_ids(spark):
    """Rows that share an id but not the text stay or go by their texts."""
    base = [f"w{i}" for i in range(60)]
    near, other, third = " ".join(base), " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    close = " ".join([*base[:-1], "end"])
    rows = [(1, near), (1, other), (2, close), (2, third), (2, third), (3, "same"), (3, "single"), (4, "same"), (5, "plain"), (None, near), (None, None)]
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    left = pipeline.exact(spark, table(spark, rows), SF)
    want = [(1, near), (1, other), (2, close), (2, third), (3, "single"), (4, "same"), (5, "plain"), (None, near), (None, None)]
    assert pairs(left) == sorted(want, key=str)
    want.remove((2, close))
    assert pairs(pipeline.near(spark, left, SF)) == sorted(want, key=str)


def test_least_score_fires(spark):
    """An even mixture of four languages goes, and so do texts in no learned language and without letters; one of three stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(pipeline.COLUMNS)
    texts = {}
    for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").collect():
        texts[r["lang"]] = (texts.get(r["lang"], "") + " " + r["text"])[:3000]
    four = [texts[k] for k in sorted(texts)[:4]]
    new = table(spark, [(-1, " ".join(four)), (-2, " ".join(four[:3])), (-3, "привет мир " * 20), (-4, "12 345"), (-5, "xqzv wkjp zzzz qqqq " * 9), (-6, four[1]), (-7, None)])
    out = pipeline.language(spark, docs.unionByName(new.selectExpr(*[f"CAST({c} AS {t}) AS {c}" for c, t in docs.dtypes])), SF)
    assert {r["doc_id"] for r in out.where("doc_id < 0").collect()} == {-2, -6}


def test_stage_edges(spark):
    """Empty tables, null columns, clashing extra columns and very long texts go through every stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, empty, SF)
        assert out.count() == 0 and out.columns[0] == "doc_id"
        if stage is not pipeline.tokens:
            assert out.columns == pipeline.COLUMNS
    long = " ".join(r["text"] for r in docs.where("lang = 'en'").orderBy("doc_id").limit(150).collect())
    rows = [(1, long, None, None, None), (2, None, None, None, None), (3, long, "en", "s", 3), (None, long, "en", None, None)]
    some = spark.createDataFrame(rows, docs.schema)
    for c in ("id", "text_sha256", "kept", "spans", "score", "hits"):
        some = some.withColumn(c, F.lit("extra"))
    labelled = docs.unionByName(some, allowMissingColumns=True)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    kept = pipeline.language(spark, labelled, SF)
    assert kept.columns == pipeline.COLUMNS and {1, 3, None} <= set(ids(kept)) and kept.where("lang IS NULL").isEmpty()
    assert ids(pipeline.exact(spark, some, SF)) == ids(some.where("doc_id IS NULL OR doc_id IN (2, 3)"))
    assert ids(pipeline.near(spark, some, SF)) == ids(some.where("doc_id IS NULL OR doc_id IN (1, 2)"))
    assert set(ids(pipeline.clean(spark, some, SF))) <= {1, 2, 3, None}
    got = {r["doc_id"]: r["n_tokens"] for r in pipeline.tokens(spark, some, SF).collect()}
    assert got[2] == 0 and got[1] == got[3] > 1000
