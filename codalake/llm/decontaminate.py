"""Benchmark decontamination by Wu-Manber search over words.

A window (10 consecutive words of an item, or a shorter item as a whole) is a pattern;
its letters are word numbers. For each pattern length m there is a shift table by blocks
of two words: where a block cannot end within a pattern, the search skips m - 1 words;
where it can end one (shift 0), the suffix bucket of that block names the patterns to
compare directly. Documents are scanned where they lie, without a shuffle.

The benchmark is a query set: it is read in blocks of at most BLOCK_WINDOWS windows,
each compiled and broadcast by itself, so neither the driver nor a worker ever holds
more than one block per scan. With several blocks the results of each are merged by row.

Results for unusual input: null and word-less texts have no words, no hits and are not
contaminated; null or word-less items are no patterns; repeated items count once by
their id; repeated documents give repeated rows; empty tables give empty results (an
empty benchmark: all documents clean); other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts

WINDOW = 10
#: Windows in one broadcast block, some 60 MB in a worker at most.
BLOCK_WINDOWS = 100_000

_WORD = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))


def words(data: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of digits, letters and all that is not ASCII."""
    return data.translate(_FOLD).split() if data else []


def windows(item: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if 0 < len(item) < size:
        yield tuple(item)
    for i in range(len(item) - size + 1):
        yield tuple(item[i : i + size])


class WuManber:
    """Patterns of words, by length; scan() yields (start, end, item ids) of each occurrence."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], size: int = WINDOW):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item_id, text in items:
            for window in windows(text, size):
                pattern = tuple(self.number.setdefault(w, len(self.number) + 1) for w in window)
                by_length.setdefault(len(pattern), {}).setdefault(pattern, set()).add(item_id)
        self.base = len(self.number) + 1  # number 0 is any word that no pattern has
        self.tables = [(m, *self._compile(m, found)) for m, found in sorted(by_length.items())]

    def _compile(self, m: int, patterns: dict) -> tuple[dict[int, int], dict[int, list]]:
        """Shift by block (absent: m - block + 1) and the patterns by their last block."""
        shift: dict[int, int] = {}
        bucket: dict[int, list] = {}
        for pattern, ids in patterns.items():
            for end in range(min(2, m) - 1, m):
                block = pattern[end] + (pattern[end - 1] * self.base if m > 1 else 0)
                shift[block] = min(shift.get(block, m), m - 1 - end)
            last = pattern[-1] + (pattern[-2] * self.base if m > 1 else 0)
            bucket.setdefault(last, []).append((list(pattern), sorted(ids)))
        return shift, bucket

    def scan(self, text: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        get, base, n = self.number.get, self.base, len(text)
        ids = [get(w, 0) for w in text]
        for m, shift, bucket in self.tables:
            most, move, i = max(1, m - 1), shift.get, m - 1
            while i < n:
                block = ids[i] + (ids[i - 1] * base if m > 1 else 0)
                step = move(block, most)
                if step:
                    i += step
                    continue
                window = ids[i - m + 1 : i + 1]
                for pattern, items in bucket[block]:
                    if pattern == window:
                        yield i - m + 1, i + 1, items
                i += 1


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of at most `most` windows; a longer item is cut into overlapping parts."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("binary"))
    block, n = [], 0
    for item_id, text in rows.toLocalIterator():
        item = words(bytes(text) if text is not None else None)
        for at in range(0, max(1, len(item) - size + 1), most):
            part = item[at : at + most + size - 1]
            if block and n + len(part) > most:
                yield block
                block, n = [], 0
            if part and item_id is not None:
                block.append((item_id, part))
                n += len(part)
    if block:
        yield block


FIELDS = [("n_words", "bigint"), ("hits", "array<struct<start:bigint,end:bigint>>"), ("item_ids", "array<string>")]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per document: id_col, carried columns, n_words, hits (merged word ranges, end exclusive), item_ids (sorted strings)."""
    carry = carry or []
    blocks = _blocks(benchmark, item_col, item_text_col, window, block_windows)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return map_texts(docs, id_col, text_col, FIELDS, _searcher(docs, first, window), carry)
    numbered = checkpointed(docs.select(*dict.fromkeys([id_col, text_col, *carry])).withColumn("__row", F.monotonically_increasing_id()))
    return _merged(numbered, itertools.chain([first, second], blocks), id_col, text_col, carry, window)


def _searcher(docs: DataFrame, block: list[tuple[str, list[bytes]]], window: int):
    shared = docs.sparkSession.sparkContext.broadcast(WuManber(block, window))

    def rows(texts):
        search = shared.value
        for i, data in enumerate(texts):
            text = words(data)
            found = list(search.scan(text))
            spans = [{"start": s, "end": e} for s, e in merge(x[:2] for x in found)] if found else []
            yield i, len(text), spans, sorted({x for _, _, ids in found for x in ids})

    return rows


def _merged(numbered: DataFrame, blocks: Iterable[list], id_col: str, text_col: str, carry: list[str], window: int) -> DataFrame:
    """With several blocks each row has a number, written once, by which its results meet."""
    parts = [map_texts(numbered, "__row", text_col, FIELDS, _searcher(numbered, block, window)) for block in blocks]
    hits = functools.reduce(DataFrame.unionByName, parts)
    by_row = hits.groupBy("__row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    out = numbered.drop(*({text_col} - {id_col, *carry})).join(by_row, "__row")
    span = "struct<start:bigint,end:bigint>"
    # Sorted ranges: each joins the last one if it begins within it.
    joined = F.aggregate(
        "hits",
        F.array().cast(f"array<{span}>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["start"] <= F.element_at(acc, -1)["end"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")).cast(span)),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    return out.select(id_col, *carry, "n_words", joined.alias("hits"), "item_ids")
