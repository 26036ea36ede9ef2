"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of each text (h = 2h + g[byte], so a byte leaves after 32
more); a chunk ends where its upper bits are zero, at least MIN_BYTES and at most MAX_BYTES
after the last end. The ends depend on nearby bytes only, so an insertion moves no chunk
beyond its surroundings. Chunks with equal 64-bit digests are repeats; a repeat is
reported where neighbouring repeated chunks cover MIN_WORDS words together, which also
makes a chance agreement of digests irrelevant. A run that covers RUN_WORDS but not MIN_WORDS may
be a longer passage, whose ends lie within chunks. It is reported if another document has a window of
MIN_WORDS words that holds the run's longest chunk. Of the windows around all places of that chunk, every
STRIDE-th is compared first, and so are the shorter ones that any window contains one of: only where
another document has one of these, but no whole window yet, all windows are compared. A run is split where it passes from
chunks that its document holds first to chunks that others do, so that of each repeated
chunk the copy of its first holder is kept. Others' chunks of less than RUN_WORDS words
together are no passage by themselves: beside chunks of the document's own they stay with these.

Digests are counted with partial sums before the shuffle; chunks then meet the repeated digests in a join
whose very frequent keys AQE splits. A chunk's row is three numbers; texts stay where they are while the documents with
short runs are few enough for a broadcast of their chunks, else they meet them in one shuffle.

Results for unusual input: null and empty texts have no chunks; a text shorter than a
chunk is one chunk; a row that is there twice is one document and repeats nothing by
that; a passage that only a single document repeats is none, as the operator is defined over
documents; ties between holders go to the smallest id; an empty table gives an empty result;
rows with a null id and other columns are ignored.

The result reads tables in the folder of spark.checkpoint.dir; those that it doesn't read are deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tune
from .groups import small
from .hashing import numbers, span_hashes

#: A chunk has 12 + 16 bytes on average: a passage of 50 words holds several whole ones.
MIN_BYTES, MAX_BYTES, BITS = 12, 160, 4
#: Least words of a reported passage.
MIN_WORDS = 50
#: Least words that the chunks of a run cover. A passage of 50 words loses some 10 at its two ends, before its first and after its last chunk end.
RUN_WORDS = 25

#: Distance of the windows by which places are compared first.
STRIDE = 6
#: Places of chunks that are broadcast to the texts, some 60 MB; for more, both meet in a shuffle.
BROADCAST_PLACES = 2_000_000

_GEAR = (numbers(256, 7) >> np.uint64(32)).astype(np.uint32)


def _cuts(ends: list[int], size: int) -> list[int]:
    """Chunk ends of a text of so many bytes, the last one at its end. ends: where the gear hash asks for one."""
    out, last = [], 0
    for e in ends:
        while e - last > MAX_BYTES:
            last += MAX_BYTES
            out.append(last)
        if e - last >= MIN_BYTES:
            out.append(e)
            last = e
    while size - last > MAX_BYTES:
        last += MAX_BYTES
        out.append(last)
    if last < size:
        out.append(size)
    return out


# Fixed value: the bytes that part words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes between the texts of a part: more than the gear hash covers.
_GAP = 32
#: Bytes of texts that are cut together.
PART = 1 << 18


def chunk_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end, words that begin in it, and digest of each chunk of some texts, none of them empty."""
    data = (b" " * _GAP).join(texts)
    raw = np.frombuffer(data, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + _GAP)[:-1]])
    h = _GEAR[raw]
    for at, n in zip(begin.tolist(), sizes.tolist(), strict=True):
        h[at + n : at + n + _GAP] = 0  # a text sees nothing of the one before
    span = 1
    while span < 32 and span < len(h):  # doubles the bytes that the hash covers
        h[span:] += h[:-span] << np.uint32(span)
        span *= 2
    asked = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    cut = np.searchsorted(asked, np.concatenate([begin, begin + sizes]), "right").reshape(2, -1)
    found = [_cuts((asked[i:j] - at).tolist(), n) for i, j, at, n in zip(cut[0], cut[1], begin.tolist(), sizes.tolist(), strict=True)]
    which = np.repeat(np.arange(len(texts)), [len(x) for x in found])
    end = np.array([e for x in found for e in x], np.int64)
    start = np.concatenate([[0], end[:-1]])
    start[np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))] = 0
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    count = np.concatenate([[0], np.cumsum(begins)])
    a, b = start + begin[which], end + begin[which]
    return which, start, end, count[b] - count[a], span_hashes(data, a, b)


def chunk(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, words that begin in it, and digest of each chunk of a text that is not empty."""
    return chunk_all([data])[1:]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk: id_col, place (start << 20 | size << 8 | words), digest."""
    spark = docs.sparkSession
    tune(spark)
    kind = dict(docs.dtypes)[id_col]
    src = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary").alias("__text")).where(F.col(f"`{id_col}`").isNotNull() & F.col("__text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, numbers_, size = [], [], 0

            def cut(batch=batch):
                which, start, end, words, digest = chunk_all(texts)
                index = pa.array(np.array(numbers_)[which])
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(index), pa.array(start << 20 | (end - start) << 8 | words), pa.array(digest.view(np.int64))],
                    names=[id_col, "place", "digest"],
                )

            for i, data in enumerate(batch.column(1).to_pylist()):
                if not data:
                    continue
                texts.append(data)
                numbers_.append(i)
                size += len(data)
                if size > PART:
                    yield cut()
                    texts, numbers_, size = [], [], 0
            if texts:
                yield cut()

    return src.mapInArrow(run, f"`{id_col}` {kind}, place bigint, digest bigint")


def repeated_chunks(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chunks that more than one document has: id, place, digest, first_id (smallest holder)."""
    rows = chunks(docs, id_col, text_col).withColumnRenamed(id_col, "id")
    groups = rows.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("first_id != last_id").select("digest", "first_id")
    # Written first, so that the join is a stage by itself in which AQE may split the rows of a very frequent digest.
    groups = scratch.keep("groups", groups)
    return rows.join(groups, "digest").select("id", "place", "digest", "first_id")


def _split(own: np.ndarray, words: np.ndarray, least: int) -> list[tuple[int, int, bool]]:
    """(first chunk, end, kept) of the parts of a run. own: which of its chunks the document holds first."""
    edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])).tolist()
    out: list[tuple[int, int, bool]] = []
    for a, b in zip(edge, edge[1:], strict=False):
        mine = bool(own[a]) or (len(edge) > 2 and int(words[a:b].sum()) < least)
        if out and out[-1][2] == mine:
            out[-1] = (out[-1][0], b, mine)
        else:
            out.append((a, b, mine))
    return out


_RUN = "doc_id {0}, start bigint, end bigint, n_words bigint, n_chunks bigint, first_ids array<{0}>, kept boolean, leads boolean, ends boolean, sure boolean, place bigint"


def _runs(found: DataFrame, min_words: int, run_words: int) -> DataFrame:
    """The parts of all runs of run_words or more. leads and ends: whether a part is its run's first and last one; sure: the
    run's chunks cover min_words; place: of the run's longest chunk."""
    kind = dict(found.dtypes)["id"]
    by_doc = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("place", "first_id"))).alias("parts"))
    schema = _RUN.format(kind)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (me, parts) in enumerate(zip(batch.column("id"), batch.column("parts"), strict=True)):
                values = parts.values
                place = values.field("place").to_numpy()
                if not len(place):
                    continue
                first = values.field("first_id")
                own = pc.equal(first, me).to_numpy(zero_copy_only=False)
                s, n, w = place >> 20, (place >> 8) & 0xFFF, place & 0xFF
                edge = np.flatnonzero(np.concatenate([[True], s[1:] != (s + n)[:-1], [True]]))
                for a, b in zip(edge, edge[1:], strict=False):
                    covered = int(w[a:b].sum())
                    if covered < run_words:
                        continue
                    anchor = a + int(np.argmax(n[a:b]))  # the longest: mostly the same one in all copies of a passage
                    for c, d, mine in _split(own[a:b], w[a:b], run_words):
                        at.append(i)
                        leads, ends = c == 0, d == b - a
                        c, d = a + c, a + d
                        rows.append((int(s[c]), int(s[d - 1] + n[d - 1]), int(w[c:d].sum()), int(d - c), sorted(set(first[c:d].to_pylist())), mine, leads, ends, covered >= min_words, int(place[anchor])))
            ids = batch.column("id").take(pa.array(at, pa.int64()))
            kinds = [pa.int64()] * 4 + [pa.list_(ids.type)] + [pa.bool_()] * 4 + [pa.int64()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *made], names=names)

    return by_doc.mapInArrow(run, schema)


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _within(starts: np.ndarray, ends: np.ndarray, place: int) -> tuple[int, int]:
    """The first and the last whole word of a chunk; without any, the word that it lies in."""
    begin, end = place >> 20, (place >> 20) + ((place >> 8) & 0xFFF)
    first, last = int(np.searchsorted(starts, begin)), int(np.searchsorted(ends, end, "right")) - 1
    if first > last:
        first = last = max(0, int(np.searchsorted(starts, begin, "right")) - 1)
    return first, last


def windows(data: bytes, place: int, size: int, stride: int = 1, shorter: int = 0, words: tuple[np.ndarray, np.ndarray] | None = None) -> list[int]:
    """Digests of the windows of size - shorter words that begin a multiple of stride words before the chunk at place, and
    not so early that one of `size` words would not hold the whole chunk."""
    starts, ends = words or _words(data)
    first, last = _within(starts, ends, place)
    length = size - shorter
    return [_hash(data[starts[i] : ends[i + length - 1]]) for i in range(first, max(0, last + 1 - size) - 1, -stride) if i + length <= len(starts)]


def _contexts(docs: DataFrame, places: DataFrame, size: int, stride: int) -> DataFrame:
    """id, place, whole (windows of `size` words), part (those that any such window contains one of). places: id, place."""
    kind = dict(docs.dtypes)["id"]
    n = places.limit(BROADCAST_PLACES + 1).count()
    own = places.groupBy("id").agg(F.collect_set("place").alias("places"))
    src = docs.join(small(own, n, BROADCAST_PLACES), "id").select("id", F.col("text").cast("binary").alias("text"), "places")
    names = ["id", "place", "whole", "part"]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []

            def flush(batch=batch):
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *made], names=names)

            for i, (data, here) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = _words(data)
                for place in here:
                    if part := windows(data, place, size, stride, stride - 1, words):
                        at.append(i)
                        rows.append((place, windows(data, place, size, stride, 0, words), part))
                if len(at) > 5_000:
                    yield flush()
                    at, rows = [], []
            if at:
                yield flush()

    return src.mapInArrow(run, f"id {kind}, place bigint, whole array<bigint>, part array<bigint>")


def _agreeing(contexts: DataFrame, mine: DataFrame, column: str) -> DataFrame:
    """The places of mine (id, place) around which another document has one of the windows of the column."""
    every = contexts.select("id", F.explode(column).alias("window"))
    shared = every.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low != high").select("window")
    own = contexts.join(mine, ["id", "place"]).select("id", "place", F.explode(column).alias("window"))
    return own.join(shared, "window").select("id", "place").distinct()


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """One row per repeated passage of a document: doc_id, start and end (bytes of UTF-8) of its chunks, n_words (that begin in
    these; the passage reaches some words further on either side), n_chunks, first_ids (documents that hold parts of it first, sorted), kept (this
    document holds it first, but for parts of less than run_words words). The parts of a run that is split may have fewer words; the
    whole run has min_words."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    found = scratch.keep("found", repeated_chunks(docs, scratch, id_col, text_col))
    scratch.drop("groups")
    runs = scratch.keep("runs", _runs(found, min_words, run_words))
    columns = ["doc_id", "start", "end", "n_words", "n_chunks", "first_ids", "kept"]
    sure = runs.where("sure").select(columns)
    short = runs.where("NOT sure")
    mine = scratch.keep("mine", short.select(F.col("doc_id").alias("id"), "place").distinct())
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text IS NOT NULL")

    def around(mine: DataFrame, stride: int) -> DataFrame:
        """The contexts of all places of the chunks at mine."""
        digests = scratch.keep("digests", found.join(mine, ["id", "place"]).select("digest").distinct())
        places = scratch.keep("places", found.join(digests, "digest").select("id", "place"))
        return scratch.keep("contexts", _contexts(texts, places, min_words, stride))

    contexts = around(mine, STRIDE)
    whole = scratch.keep("whole", _agreeing(contexts, mine, "whole"))
    open_ = scratch.keep("open", _agreeing(contexts, mine, "part").join(whole, ["id", "place"], "left_anti"))
    rest = scratch.keep("rest", _agreeing(around(open_, 1), open_, "whole"))
    longer = short.join(whole.unionByName(rest).withColumnRenamed("id", "doc_id"), ["doc_id", "place"], "left_semi").select(columns)
    longer = scratch.keep("longer", longer)
    scratch.drop_all_but("runs", "longer")
    return sure.unionByName(longer)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id_col, text: each text without the passages that a document with a smaller id holds first. Rows with a null id stay as they are."""
    passages = repeated_passages(docs, id_col, text_col, min_words).where("NOT kept")
    cut = passages.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cut")).withColumnRenamed("doc_id", id_col)
    both = docs.select(id_col, text_col).join(cut, id_col, "left")

    @F.pandas_udf("string")
    def kept(text, cut):
        def one(t, spans):
            if spans is None or t is None:
                return t
            data, at, out = t.encode(), 0, []
            for s in spans:
                out.append(data[at : s["start"]])
                at = s["end"]
            return b"".join([*out, data[at:]]).decode("utf-8", "ignore")

        import pandas as pd

        return pd.Series([one(t, c) for t, c in zip(text, cut, strict=True)])

    return both.select(id_col, kept(text_col, "cut").alias("text"))
