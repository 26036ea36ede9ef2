"""Nulls, empty and long texts, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("codalake.llm")
import public_tokenizers  # noqa: E402

from codalake.llm import bpe, decontaminate, exact_dedup, langid, licenses, near_dedup, pii, secrets, substring_dedup, url_filter  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = "the quick brown fox jumps over " * 4000
ROWS = [(1, None), (2, ""), (3, "   \n\t "), (4, "déjà vu of the quick brown fox"), (5, LONG), (5, LONG), (6, "x"), (None, "the quick brown fox"), (7, "12 345 @ token ="), (8, "é" * 30_000)]


def ops():
    bench = "SELECT 'a' AS item_id, 'quick brown fox' AS text UNION ALL SELECT 'b', NULL UNION ALL SELECT 'c', '...'"
    return {
        "pii": lambda d: pii.scan_pii(d),
        "secrets": lambda d: secrets.scan_secrets(d),
        "licenses": lambda d: licenses.scan_licenses(d),
        "decontaminate": lambda d: decontaminate.decontaminate(d, d.sparkSession.sql(bench)),
        "exact": lambda d: exact_dedup.exact_dedup(d),
        "near": lambda d: near_dedup.near_dedup(d),
        "bpe": lambda d: bpe.bpe_round_trip(d, TOKENIZER),
        "langid": lambda d: langid.identify(d, langid.fit(d)),
    }


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None) for i, t in ROWS], "doc_id bigint, text string, lang string").cache()


@pytest.mark.parametrize("name", sorted(ops()))
def test_row_for_row(docs, name):
    """As many rows as came in, ids kept, and the same result with clashing columns beside them."""
    op = ops()[name]
    plain = op(docs)
    got = sorted(map(str, plain.collect()))
    assert len(got) == len(ROWS)
    odd = docs
    for c in ("spans", "kept", "n_words", "hits", "ids", "digest", "id", "score", "node", "size", "a", "__row", "count"):
        odd = odd.withColumn(c, F.lit("extra"))
    again = op(odd)
    assert again.columns == plain.columns
    assert sorted(map(str, again.collect())) == got


@pytest.mark.parametrize("name", sorted(ops()))
def test_empty_table(docs, name):
    assert ops()[name](docs.limit(0)).count() == 0


def test_empty_texts(docs):
    run = lambda f: {r["doc_id"]: r for r in f(docs).collect()}
    o = ops()
    assert all(not r["spans"] for i, r in run(o["pii"]).items() if i != 7)
    assert [run(o["licenses"])[i]["n_paragraphs"] for i in (1, 2, 3)] == [0, 0, 0]
    hit = run(o["decontaminate"])
    assert [hit[i]["n_words"] for i in (1, 2, 3)] == [0, 0, 0] and hit[4]["item_ids"] == ["a"] and hit[4]["hits"][0]["end"] - hit[4]["hits"][0]["start"] == 3
    ids = run(o["bpe"])
    assert ids[1]["ids"] == [] and ids[1]["decoded"] == "" and ids[5]["decoded"] == LONG
    lang = run(o["langid"])
    assert [lang[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and lang[4]["lang_pred"] == "en"
    ex = run(o["exact"])
    assert ex[1]["keep_id"] == ex[2]["keep_id"] == 2 and ex[5]["group_size"] == 2
    near = run(o["near"])
    assert [near[i]["component_id"] for i in (1, 2, 3)] == [1, 2, 3] and near[1]["n_shingles"] == 0
    assert near[None]["component_id"] is None


def test_unlabelled_language(docs):
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))).collect()} == {"und"}


def test_substring_edges(spark, docs):
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0
    # The long text stands on two rows of one id: it is one document and repeats nothing.
    assert substring_dedup.repeated_passages(docs.withColumn("id", F.lit(1)).withColumn("digest", F.lit(2))).count() == 0


def test_url_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://"), (4, "http://A.Net/es/x"), (4, "http://A.Net/es/x"), (5, "://x.com?y")], "page_id int, url string")
    rows = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(df.withColumn("host", F.lit("z")).withColumn("tokens", F.lit("z"))).collect())
    assert rows == [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "/es/x", "net/es/", "block"), (4, "a.net", "/es/x", "net/es/", "block"), (5, "x.com", "", None, "allow")]
    assert url_filter.filter_urls(df.limit(0)).count() == 0
