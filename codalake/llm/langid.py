"""Language identification by multilingual mixture inference.

Training learns, for each language, the likelihood of character n-grams (hashed 1- to
4-grams of letters within words). A document is a mixture of languages: expectation-
maximisation estimates the proportions from its n-gram likelihoods, for every number of
languages from one up, and the set with the best penalised likelihood is selected. The
part of a text that no learned language explains better than chance (n-grams drawn evenly)
is estimated by one more component. Each
document is scored where it lies, over its whole text, without a shuffle.

The score is a confidence: the share of the predicted language, times the share of the text
that is in any of the selected languages, times the probability that the language is in the
text at all (the likelihood with it against the best one without it). A long text in one
language has nearly 1, a mixture the language's share, a single letter about the reciprocal of the
number of languages, and a text in no learned language nearly 0.

The model is a classifier fitted on a bounded sample: about `per_language` labelled
documents of each language, chosen by a hash of their id with a rate computed from exact
counts, so that any input gives the same expected sample. It is counted on the executors;
only its sums (languages x BUCKETS numbers) come to the driver.

Results for unusual input: a text that is null or has no letter is 'und' with score 0,
an empty language set and no proportions; with no labelled text at all every text is
'und'; null labels are not learned from; ties go to the language that sorts first; rows
that are there twice give two rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, tune

BUCKETS = 1 << 15
#: Expected number of documents of each language in the sample that the model is fitted on.
PER_LANGUAGE = 2_000
#: Weight of an n-gram: the four n-grams that end at one letter overlap and count as one observation.
_SHARE = 0.25
_LETTER = re.compile(r"[^\W\d_]")
_SEED = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points; every run of anything else is one 0, also at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    letter = (raw >= 97) & (raw <= 122)
    high = np.flatnonzero(raw >= 128)
    if high.size:
        chars, place = np.unique(raw[high], return_inverse=True)
        letter[high] = np.array([chr(int(c)).isalpha() for c in chars])[place]
    raw[~letter] = 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate([np.zeros(1, np.uint64), raw[keep], np.zeros(1, np.uint64)])


def features(text: str) -> np.ndarray:
    """The bucket of every n-gram, n = 1 to 4, that ends in a letter or a word's end and does not span words."""
    codes = _codes(text)
    h = np.zeros(len(codes), np.uint64)
    inside = np.ones(len(codes), bool)
    out = []
    for n in range(1, 5):
        back = n - 1
        part = np.zeros(len(codes), np.uint64)
        part[back:] = codes[: len(codes) - back]
        with np.errstate(over="ignore"):
            h = h * np.uint64(0x100000001B3) + part + np.uint64(n)
            if back >= 2:  # the letter that was first is inside now: no word gap there
                gap = np.zeros(len(codes), np.uint64)
                gap[back - 1 :] = codes[: len(codes) - back + 1]
                inside &= gap > 0
            good = inside.copy()
            good[:back] = False
            if n == 1:
                good &= codes > 0
            mixed = h[good] * _MIX
        out.append((mixed >> np.uint64(40)) & np.uint64(BUCKETS - 1))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # languages x buckets

    def __post_init__(self):
        """The likelihoods relative to the likeliest language of each bucket, as EM needs them."""
        self.top = self.log_p.max(axis=0) if self.languages else np.zeros(BUCKETS)
        self.p = np.exp(self.log_p - self.top) + 1e-12
        self.chance = np.exp(-np.log(BUCKETS) - self.top)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE, smoothing: float = 0.1) -> Model:
    """The model of the labelled rows of docs (null labels and texts are left out)."""
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    rate = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < rate).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS, np.int64)
                sums[lang] += np.bincount(features(text), minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])

    # The sample alone is shuffled, to few partitions with few sums; all of the table's splits are read by tasks of their own.
    summed = sample.repartition(64).mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((len(languages), BUCKETS), smoothing)
    place = {k: i for i, k in enumerate(languages)}
    got = summed.toArrow()
    langs = np.array([place[k] for k in got.column("lang").to_pylist()], dtype=np.int64)
    if len(langs):
        np.add.at(table, (langs, got.column("bucket").to_numpy()), got.column("n").to_numpy())
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def _mixture(p: np.ndarray, weight: np.ndarray, rounds: int = 12, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Proportions by expectation-maximisation, and their log-likelihood. p: likelihoods, languages x n-grams."""
    share = np.full(len(p), 1.0 / len(p))
    total = weight.sum()
    for _ in range(rounds):
        before, share = share, share * (p @ (weight / (share @ p))) / total
        if np.abs(share - before).max() < tol:
            break
    return share, float(weight @ np.log(share @ p))


def infer(text: str | None, model: Model) -> tuple[str, float, list[str], list[float]]:
    """(language, score, selected languages by share, their shares)."""
    if not text or not model.languages or not _LETTER.search(text):
        return "und", 0.0, [], []
    found = np.bincount(features(text), minlength=BUCKETS)
    at = np.flatnonzero(found)
    if not at.size:
        return "und", 0.0, [], []
    weight = found[at] * _SHARE
    p = model.p[:, at]
    top = weight @ model.top[at]
    single = model.log_p[:, at] @ weight
    # Each further language costs half the logarithm of the observations, as its share is one more number to state.
    cost = 0.5 * np.log(1.0 + weight.sum())
    first = int(np.argmax(single))
    best, chosen, shares = single[first], [first], np.ones(1)
    if len(model.languages) > 1:
        full, _ = _mixture(p, weight)
        order = list(np.argsort(-full, kind="stable"))
        for k in range(2, len(order) + 1):
            share, likelihood = _mixture(p[order[:k]], weight)
            value = likelihood + top - (k - 1) * cost
            if value <= best + 1e-9:
                break
            best, chosen, shares = value, order[:k], share
    rank = sorted(range(len(chosen)), key=lambda i: (-shares[i], chosen[i]))
    names = [model.languages[chosen[i]] for i in rank]
    # The best explanation without the first language: the others of the set, or the next language alone.
    dominant = chosen[rank[0]]
    others = [i for i in chosen if i != dominant]
    without = max([single[i] for i in range(len(single)) if i != dominant], default=-np.inf)
    if len(others) > 1:
        without = max(without, _mixture(p[others], weight)[1] + top)
    there = 1.0 / (1.0 + np.exp(np.clip(without - best - (len(chosen) - 1) * cost, -700, 700)))
    with_chance, likelihood = _mixture(np.vstack([p[chosen], model.chance[at]]), weight)
    inside = 1.0 - with_chance[-1] if likelihood + top - len(chosen) * cost > best else 1.0
    score = float(np.clip(shares[rank[0]] * there * inside, 0.0, 1.0))
    return names[0], score, names, [float(shares[i]) for i in rank]


FIELDS = [("lang_pred", "string"), ("score", "double"), ("languages", "array<string>"), ("shares", "array<double>")]


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, carried columns, lang_pred, score, languages, shares."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def rows(texts):
        for i, data in enumerate(texts):
            yield i, *infer(data.decode("utf-8", "replace") if data else None, shared.value)

    return map_texts(docs, id_col, text_col, FIELDS, rows, carry)
