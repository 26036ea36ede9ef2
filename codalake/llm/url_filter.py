"""URL filtering with given rules and association rules mined from what they label.

Given rules (host suffix and path prefix, longest wins) judge a part of the urls. These
verdicts are labels: Spark's FP-growth mines, over the labelled urls, which combinations
of url tokens go with which label. A mined rule needs support and confidence. Other urls are judged by the rules that are
confirmed, matched through an inverted index from a rule's first token to the rule.

The labels come from a few given rules and are no fair sample of the other urls, so a mined rule must hold beyond
the rows that it was mined from, and beyond the given rules that it was mined from:

* A fifth of the labelled urls (by a hash of the url) is held out; the rule must be right for MIN_CONFIDENCE of those that it fits.
* A given rule that labels by a path says nothing about its host: it is evidence for a combination that holds a part of its host only if that
  holds its path's segments too.
* Each given rule that is evidence is left out in turn: the others must give the rule its confidence, and it must then be
  right about the urls of the one left out. So SOURCES given rules or more must give its label.
* Its label must be LIFT times as frequent among the urls that it fits as among all labelled ones.

Of the confirmed rules one is dropped if another on a part of its tokens is as confident (it would never decide); as this is done after
the confirmation, a longer combination stands where its parts fail. MIN_ROWS is the least support in rows.

Every part of a url gives tokens: all host suffixes, the parts of hyphenated host labels, all path
segments, all query parameters and their names. There is no bound on a rule's tokens. Tokens that stand in exactly the same labelled urls
are mined as one and give a rule each, as the sets of such tokens would only repeat one another. FP-growth's frequent sets, which bound the
broadcast, are a matter of the support: many frequent tokens that often come together, and are not the same, make many sets. Urls are
judged where they lie, without a shuffle.

Results for unusual input: a url that is null or has no "://" has empty host and path,
no rule, no tokens and the default verdict; without labelled urls or mined rules, the
default verdict is given; rows that are there twice give two rows and count twice in
mining; ties between mined rules go to the higher support, then more tokens, then the
smaller text; an empty table gives an empty result; other columns are ignored, whatever their names, and the id column may have
any name but those of the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import product

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tune

# Verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIN_SUPPORT = 0.002
MIN_ROWS = 10
MIN_CONFIDENCE = 0.8
LIFT = 1.1
SOURCES = 2
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.instr(url, "://")
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise(F.lit(""))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1), F.lit(""))
    return host, path


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host + path, as text) and its verdict; null without one."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def query_of(url: Column) -> Column:
    found = F.instr(url, "://")
    return F.coalesce(F.when(found > 0, F.regexp_extract(F.substring(url, found + 3, F.length(url)), r"^[^?#]*\?([^#]*)", 1)), F.lit(""))


def tokens(host: Column, path: Column, query: Column | None = None) -> Column:
    """All host suffixes (h:), parts of hyphenated host labels (w:), path segments (p:), and query parameters with and without value (q:)."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    n = F.size(labels)
    none = F.array().cast("array<string>")
    suffixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, n - k + 1, k), ".")))).otherwise(none)
    parts = F.filter(F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "-"))), lambda x: x != "")
    found = [suffixes, F.transform(parts, lambda x: F.concat(F.lit("w:"), x)), F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))]
    if query is not None:
        given = F.filter(F.split(query, "&"), lambda x: x != "")
        found += [F.transform(given, lambda x: F.concat(F.lit("q:"), x)), F.transform(given, lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))]
    return F.array_distinct(F.concat(*found))


Rule = tuple[tuple[str, ...], str, float, float]
#: What an item of FP-growth begins with that is a label; no token does.
_LABEL = "="


def same_rows(labelled: DataFrame, least: int) -> dict[str, list[str]]:
    """The tokens of each class that stand in the same rows, by the first of them; of those with the support, which are at most (mean tokens of a
    url) / MIN_SUPPORT. Two tokens are in the same rows if these agree in number, and in the sums of two hashes of the row."""
    rows = labelled.select(F.explode(F.array_distinct("tokens")).alias("token"), "label", F.xxhash64("tokens").alias("h"), F.xxhash64("tokens", F.lit(1)).alias("g"))
    part = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g"))
    found = part.groupBy("token").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("h").alias("h"), F.sum("g").alias("g")).where(F.col("most") >= least)
    classes: dict[tuple, list[str]] = {}
    for r in found.orderBy("token").collect():
        classes.setdefault((r["n"], r["h"], r["g"]), []).append(r["token"])
    return {names[0]: names for names in classes.values()}


def mine_all(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = 1) -> list[Rule]:
    """(tokens, label, confidence, support) of all rules with support and confidence, with one token of each class for all of them.
    labelled: tokens, label."""
    n = labelled.count()
    if not n:
        return []
    least = max(min_rows, math.ceil(min_support * n))
    classes = same_rows(labelled, least)
    if not classes:
        return []
    firsts = labelled.sparkSession.sparkContext.broadcast(frozenset(classes))

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[*sorted(firsts.value.intersection(words)), _LABEL + label] for words, label in zip(batch.column("tokens").to_pylist(), batch.column("label").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.string()))], names=["items"])

    baskets = labelled.select("tokens", "label").mapInArrow(items, "items array<string>")
    # Half a row less, so that rounding loses no set that has the support.
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, (least - 0.5) / n), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.element_at("consequent", 1).startswith(_LABEL) & ~F.exists("antecedent", lambda x: x.startswith(_LABEL)))
    rows = rules.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 2, 1 << 20).alias("label"), "confidence", "support").collect()  # bounded by the support
    return [(tuple(r["tokens"]), r["label"], r["confidence"], r["support"]) for r in rows if r["confidence"] >= min_confidence]


def expanded(rules: list[Rule], classes: dict[str, list[str]]) -> list[Rule]:
    """The rules with each token of a class in the place of its first."""
    return [(tuple(sorted(names)), *r[1:]) for r in rules for names in product(*(classes.get(t, [t]) for t in r[0]))]


def pruned(rules: list[Rule]) -> list[Rule]:
    """The rules without those on a part of whose tokens another is as confident of the label; by precedence."""
    kept: list[Rule] = []
    index: dict[tuple[str, str], list[frozenset]] = {}
    # Shorter ones first: the parts of a rule that count are those that are kept.
    for r in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        have = frozenset(r[0])
        parts = (p for t in r[0] for p in index.get((t, r[1]), ()))
        if not any(p[0] < have and p[1] >= r[2] for p in parts):
            kept.append(r)
            index.setdefault((r[0][0], r[1]), []).append((have, r[2]))
    return sorted(kept, key=lambda r: (-r[2], -r[3], -len(r[0]), r[0]))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = 1) -> list[Rule]:
    """The rules that mining alone gives, pruned."""
    least = max(min_rows, math.ceil(min_support * labelled.count()))
    found = pruned(mine_all(labelled, min_support, min_confidence, min_rows))
    return pruned(expanded(found, same_rows(labelled, least))) if found else []


class RuleIndex:
    """Rules in their order of precedence; match() gives the first that holds, fitting() the places of all that do."""

    def __init__(self, rules: list[Rule]):
        self.rules = [(frozenset(r[0]), r[1], r[2]) for r in rules]
        self.by_token: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            self.by_token.setdefault(r[0][0], []).append(i)

    def fitting(self, tokens_: list[str]) -> list[int]:
        have = set(tokens_)
        return sorted(i for t in have for i in self.by_token.get(t, ()) if self.rules[i][0] <= have)

    def match(self, tokens_: list[str]) -> tuple[str, float, str] | None:
        have = set(tokens_)
        best = None
        for t in have:
            for i in self.by_token.get(t, ()):
                if best is not None and i >= best:
                    break
                if self.rules[i][0] <= have:
                    best = i
                    break
        if best is None:
            return None
        need, label, confidence = self.rules[best]
        return label, confidence, " ".join(sorted(need))


def is_evidence(tokens_: tuple[str, ...], source: str) -> bool:
    """Whether a given rule (host/path) says something about a combination: not about a part of its host without its path."""
    host, _, path = source.partition("/")
    own = any(t.startswith("h:") and (t[2:] == host or t.endswith("." + host)) for t in tokens_)
    return not own or all(f"p:{x}" in tokens_ for x in path.split("/") if x)


def confirmed(rules: list[Rule], labelled: DataFrame, min_confidence: float = MIN_CONFIDENCE, lift: float = LIFT, sources: int = SOURCES) -> list[Rule]:
    """The mined rules that hold on the held-out rows, lift their label, and are told by the other given rules about each that is left
    out. labelled: tokens, label, source (the given rule), held. One pass that counts; (rules x given rules) numbers come to the driver."""
    if not rules:
        return []
    base = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    index = labelled.sparkSession.sparkContext.broadcast(RuleIndex(rules))
    names = ["rule", "source", "held", "n", "hits"]
    rules_of = [r[1] for r in rules]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        hits: Counter = Counter()
        for batch in batches:
            for words, label, source, held in zip(*(batch.column(c).to_pylist() for c in ("tokens", "label", "source", "held")), strict=True):
                for i in index.value.fitting(words):
                    n[i, source, held] += 1
                    hits[i, source, held] += label == rules_of[i]
        kinds = (pa.int32(), pa.string(), pa.bool_())
        made = [pa.array([k[j] for k in n], t) for j, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*made, pa.array(list(n.values()), pa.int64()), pa.array([hits[k] for k in n], pa.int64())], names=names)

    counts = labelled.select("tokens", "label", "source", "held").mapInArrow(count, "rule int, source string, held boolean, n bigint, hits bigint")
    own: dict[int, list] = {}
    for r in counts.groupBy("rule", "source", "held").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).collect():
        own.setdefault(r["rule"], []).append(r)
    total = sum(base.values())
    kept = []
    for i, rule in enumerate(rules):
        found = own.get(i, [])
        n, hits = sum(r["n"] for r in found), sum(r["hits"] for r in found)
        held, right = sum(r["n"] for r in found if r["held"]), sum(r["hits"] for r in found if r["held"])
        told: dict[str, list[int]] = {}
        for r in found:
            if is_evidence(rule[0], r["source"]):
                at = told.setdefault(r["source"], [0, 0])
                at[0], at[1] = at[0] + r["n"], at[1] + r["hits"]
        all_n, all_hits = sum(x[0] for x in told.values()), sum(x[1] for x in told.values())
        wide = sum(x[1] > 0 for x in told.values()) >= sources and all(
            x[1] >= min_confidence * x[0] and all_n > x[0] and all_hits - x[1] >= min_confidence * (all_n - x[0]) for x in told.values()
        )
        if held and right >= min_confidence * held and wide and hits / n >= lift * base[rule[1]] / total:
            kept.append(rule)
    return kept


def learned(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS, lift: float = LIFT, sources: int = SOURCES) -> list[Rule]:
    """The rules that are mined from the rows that are not held out, confirmed and pruned, by precedence."""
    fit = labelled.where("NOT held")
    found = mine_all(fit, min_support, min_confidence, min_rows)
    if not found:
        return []
    classes = same_rows(fit, max(min_rows, math.ceil(min_support * fit.count())))
    return pruned(confirmed(expanded(found, classes), labelled, min_confidence, lift, sources))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, mined (the mined rule that decided), confidence."""
    spark = pages.sparkSession
    tune(spark)
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parsed = pages.select(F.col(f"`{id_col}`"), host.alias("host"), path.alias("path"), query_of(F.col(f"`{url_col}`")).alias("query"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    marked = parsed.select(F.col(f"`{id_col}`"), "host", "path", rule.alias("rule"), verdict.alias("given"), tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"), "query")
    held = F.pmod(F.xxhash64("host", "path", "query"), F.lit(5)) == 0
    labelled = marked.where("given IS NOT NULL AND size(tokens) > 0").select("tokens", F.col("given").alias("label"), F.col("rule").alias("source"), held.alias("held"))
    index = spark.sparkContext.broadcast(RuleIndex(learned(labelled)))
    judged = marked.drop("query")
    kind = dict(pages.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts, mined, sure = [], [], []
            for given, words in zip(batch.column("given").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                found = index.value.match(words) if given is None else None
                verdicts.append(given or (found[0] if found else default))
                mined.append(found[2] if found else None)
                sure.append(found[1] if found else None)
            made = [pa.array(verdicts, pa.string()), pa.array(mined, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *made], names=[id_col, "host", "path", "rule", "verdict", "mined", "confidence"])

    return judged.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, mined string, confidence double")
