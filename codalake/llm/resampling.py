"""Importance resampling towards a target distribution, on hashed word n-grams.

Words are counted in batches: a batch's texts are joined with a sentinel byte that no UTF-8 text holds, one regular
expression pass finds all words and sentinels, searchsorted on the sentinels' places tells each word's document, n-grams
whose first and last word lie in different documents are masked, and bincount adds up buckets (for the corpus) or gains (for
documents). A text that is longer than a batch's bytes is cut at a word's end, with the last n - 1 words carried over, so
that memory is bounded by a batch and its longest word.

Two passes over the documents: the first counts buckets (a row for each task and bucket is shuffled, `buckets` sums reach
the driver), the second weighs each document by the mean gain of its features. The draw is by Gumbel scores, which
makes the highest scores a sample without replacement. Ranks come from counts by score: whole scores are numbered by running
sums over these counts, in two levels, and only drawn documents are ordered, within their score, equal rows as one.

Results for unusual input: a text that is null or has no word has no features, weight 0 and no rank; rows that are there
twice are two documents, each with its own rank if drawn (equal ids: by falling weight, then falling n_features); a null id counts
as empty text in the hash and comes last among ties; an empty target gives gains by the smoothing alone; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_texts, tune
from .groups import repeated, small

BUCKETS = 10_000
#: Bytes of texts that are joined at a time.
PART = 1 << 20
# A byte 255 in a text (not UTF-8 then) counts as a gap, as the sentinel is that byte.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\xff", b"abcdefghijklmnopqrstuvwxyz ")
_SENTINEL = b"\xff"
_TOKEN = re.compile(rb"[0-9a-z\x80-\xfe]+|\xff")
_WORD = re.compile(rb"[0-9a-z\x80-\xfe]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xfe]")
#: Word hashes that are kept at a time.
_KNOWN = 200_000


class _Crc(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        value = self[word] = zlib.crc32(word)
        return value


def _pieces(texts: list[bytes | None], n: int) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """Runs of pieces of about PART bytes: (documents, lower-cased pieces, how many first words of each were counted before)."""
    at, parts, carried, size = [], [], [], 0
    for i, text in enumerate(texts):
        if not text:
            continue
        start, tail = 0, []
        while start < len(text):
            gap = _GAP.search(text, start + PART) if len(text) - start > PART else None
            end = gap.start() if gap else len(text)
            piece = text[start:end].translate(_FOLD)
            if size and size + len(piece) > PART:
                yield at, parts, carried
                at, parts, carried, size = [], [], [], 0
            at.append(i)
            parts.append(b" ".join([*tail, piece]))
            carried.append(len(tail))
            size += len(piece) + 1
            if end < len(text) and n > 1:
                tail = [*tail, *_last_words(piece, n - 1)][1 - n :]
            start = end
    if at:
        yield at, parts, carried


def _last_words(piece: bytes, k: int) -> list[bytes]:
    """The last k words, by looking at ever longer ends."""
    width = 64 * k
    while True:
        start = max(0, len(piece) - width)
        words = _WORD.findall(piece, start)
        if start == 0 or len(words) > k:
            return words[-k:]
        width *= 4


def grams(texts: list[bytes | None], n: int = 1, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of pieces: (document of each feature, its bucket, document of each word). Features are all runs of 1 to n words."""
    crc = _Crc()
    for at, parts, carried in _pieces(texts, n):
        found = _TOKEN.findall(_SENTINEL.join(parts))
        codes = np.fromiter(map(crc.__getitem__, found), np.uint32, len(found))
        # The sentinel's hash may be a word's too: its place is told by the token itself.
        ends = np.fromiter((k for k, w in enumerate(found) if w == _SENTINEL), np.int64, len(parts) - 1)
        word = np.ones(len(found), bool)
        word[ends] = False
        piece = np.searchsorted(ends, np.arange(len(found)), side="right")
        place = np.arange(len(found)) - np.concatenate([[-1], ends])[piece] - 1  # within its piece
        docs, old = np.array(at), np.array(carried)
        fresh = word & (place >= old[piece])
        out_doc, out_bucket = [docs[piece[fresh]]], [codes[fresh] % np.uint32(buckets)]
        joined = codes
        for k in range(2, n + 1):
            last = len(found) - k + 1
            if last <= 0:
                break
            # A run across documents holds a sentinel: its first and last word lie in different pieces.
            good = word[:last] & word[k - 1 :] & (piece[:last] == piece[k - 1 :])
            after = np.zeros(last, np.uint32)
            for i in np.flatnonzero(good).tolist():
                after[i] = zlib.crc32(b" " + found[i + k - 1], int(joined[i]))
            joined = after
            good &= place[k - 1 :] >= old[piece[:last]]  # not all of it was counted before
            out_doc.append(docs[piece[:last][good]])
            out_bucket.append(after[good] % np.uint32(buckets))
        yield np.concatenate(out_doc), np.concatenate(out_bucket).astype(np.int64), docs[piece[fresh]]


def bucket_counts(texts: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall there."""
    tune(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in grams(batch.column(0).to_pylist(), n, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    src = texts.select(F.col(f"`{text_col}`").cast("binary").alias("text")).where("text IS NOT NULL")
    return src.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, from bucket_counts() of both."""
    counts = []
    for table in (source, target):
        got = table.toArrow()  # `buckets` rows at most
        c = np.zeros(buckets, np.int64)
        c[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        counts.append(c)
    s, t = counts
    ratio = ((t + 1.0) * (s.sum() + float(buckets))) / ((s + 1.0) * (t.sum() + float(buckets)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", n: int = 1, carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, carried columns, n_words, n_features, weight (floored mean gain, 0 without features)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def rows(texts):
        size = len(texts)
        words, features, sums = (np.zeros(size, np.int64) for _ in range(3))
        for doc, found, of_word in grams(texts, n, len(shared.value)):
            words += np.bincount(of_word, minlength=size)
            features += np.bincount(doc, minlength=size)
            # Sums of whole numbers stay exact in doubles below 2^53.
            sums += np.bincount(doc, weights=shared.value[found], minlength=size).astype(np.int64)
        weights = sums // np.maximum(features, 1)
        yield from zip(range(size), words.tolist(), features.tolist(), weights.tolist(), strict=True)

    return map_texts(docs, id_col, text_col, [("n_words", "bigint"), ("n_features", "bigint"), ("weight", "bigint")], rows, carry)


def gumbel(key: Column) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of the key's sha256."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


#: Scores that share a running sum's first level.
_COARSE = 256


def ranked(scored: DataFrame, share_percent: int, eligible: Column, scratch: Scratch) -> DataFrame:
    """scored (a written table: doc_id, n_features, weight, score, ...) with rank: of the N eligible rows the floor(share * N / 100)
    highest scores, ties to the smaller doc_id."""
    rows = scored.withColumn("can", eligible)
    counts = rows.where("can").groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", F.floor(F.col("score") / _COARSE))
    counts = scratch.keep("counts", counts)  # a row for each score that is there
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    drawn = share_percent * total // 100
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    coarse = counts.groupBy("coarse").agg(F.sum("n").alias("m"))
    sums = coarse.withColumn("base", F.coalesce(F.sum("m").over(before(Window.orderBy(F.desc("coarse")))), F.lit(0))).drop("m")
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("coarse").orderBy(F.desc("score")))), F.lit(0))
    above = counts.withColumn("within", within).join(F.broadcast(sums), "coarse").select("score", (F.col("base") + F.col("within")).alias("above"))
    above = scratch.keep("above", above.where(F.col("above") < drawn))
    joined = rows.join(small(above), "score", "left").withColumn("above", F.when(F.col("can"), F.col("above")))
    # Equal rows are numbered together, so that no score has more rows to order than it has different documents.
    classes = joined.where("above IS NOT NULL").groupBy(*scored.columns, "above").agg(F.count(F.lit(1)).alias("times"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"))
    first = F.col("above") + F.coalesce(F.sum("times").over(before(order)), F.lit(0))
    inside = repeated(classes.withColumn("first", first), "times", "copy").withColumn("place", F.col("first") + F.col("copy") + 1)
    inside = inside.select(*scored.columns, F.when(F.col("place") <= drawn, F.col("place")).cast("bigint").alias("rank"))
    outside = joined.where("above IS NULL").select(*scored.columns, F.lit(None).cast("bigint").alias("rank"))
    return inside.unionByName(outside)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    n: int = 1,
    buckets: int = BUCKETS,
    least_words: int = 20,
    share_percent: int = 10,
    seed: str = "2024",
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score, rank (null: not drawn)."""
    scratch = Scratch(docs.sparkSession, "resampling")
    source_counts = scratch.keep("source", bucket_counts(docs, text_col, n, buckets))
    target_counts = scratch.keep("target", bucket_counts(target, target_col, n, buckets))
    gain = gains(source_counts, target_counts, buckets)
    weights = weigh(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), gain, n=n)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    scored = scratch.keep("scored", weights.withColumn("score", F.col("weight") + gumbel(key)))
    out = scratch.keep("result", ranked(scored, share_percent, F.col("n_words") >= least_words, scratch))
    scratch.drop_all_but("result")
    return out
