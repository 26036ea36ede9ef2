"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

A text is cut at special tokens and then into pretokens. Within a pretoken the leaves of
a segment tree hold, for each pair of adjacent symbols, its merge rank and position; the
root is the leftmost pair of the lowest rank. Merging it changes three leaves, each in
logarithmic time, until the root holds no mergeable pair: n log n for any pretoken,
however long. Pretokens that come again are looked up in a bounded cache; those that
are new to it are merged together: their trees are the rows of one array, and each step
merges every row's root and updates its three leaves' paths. Long pretokens have a tree
each.

Documents are encoded where they lie, without a shuffle; the vocabulary (a file's
fixed size) is read on the driver and broadcast.

Results for unusual input: a null text counts as empty and has no ids; ids outside the
vocabulary decode to nothing; rows that are there twice give two rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts

#: Beyond so many pretokens, or bytes of them, a worker forgets those that it keeps before it takes the next texts.
CACHE = 300_000
CACHED_BYTES = 8 << 20

#: Characters of the texts that are encoded together, and ids or words that are expanded at once.
TOGETHER = 1 << 20
EXPANDED = 1 << 18

#: Trees of one array have so many leaves in all. Fewer rows than FEW, or pretokens of 2 ** DEEP bytes and more, get a tree each.
LEAVES = 1 << 16
FEW = 32
DEEP = 8

# Fixed value: the pretoken pattern of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Numbers(dict):
    """Numbers words in the order in which they come; fresh are the words since it was last emptied."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


def runs(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of flat that begin at start and have these sizes, one after another."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


class SegmentTreeBpe:
    """Encodes and decodes; made from the tokenizer's JSON text."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocab[c] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        top = max([*vocab.values(), *self.special.values()]) + 1
        self.bits = top.bit_length()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[a] << self.bits | vocab[b], r)
            self.made.append(vocab[a + b])
        self.bytes_of = [b""] * top
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        # The same as arrays. top is no symbol: it has no byte (but 256, which is none) and no pair.
        self.outside = top
        self.symbols = np.array([*self.first, top], np.int64)
        self.results = np.array(self.made, np.int64)
        keys = np.fromiter(self.rank.keys(), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.fromiter(self.rank.values(), np.int64, len(self.rank))[order], len(self.made))
        self.byte_ranks = self.pair_ranks(self.symbols[:, None], self.symbols).ravel()
        self.token_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.token_size = np.fromiter(map(len, self.bytes_of), np.int64, top)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self._compile()

    def _compile(self) -> None:
        self._forget()
        self.pretokens = regex.compile(PRETOKEN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _forget(self) -> None:
        self.known = Numbers()
        self.ids = np.empty(0, np.int32)
        self.start = self.size = np.empty(0, np.int64)
        self.kept_bytes = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "ids", "start", "size", "kept_bytes", "pretokens", "parts")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compile()

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges where it has none."""
        keys = left << self.bits | right
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.made))

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pretoken."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        rank, made, bits = self.rank.get, self.made, self.bits
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        shift = size.bit_length()
        mask, none = (1 << shift) - 1, len(made) << shift
        # A leaf holds rank << shift | position, so the least one is the leftmost lowest rank.
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i] << bits | ids[i + 1])
            if r is not None:
                tree[size + i] = r << shift | i
        for k in range(size - 1, 0, -1):
            left, right = tree[2 * k], tree[2 * k + 1]
            tree[k] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        least = tree[1]
        while least < none:
            i = least & mask
            j = after[i]
            ids[i] = new = made[least >> shift]
            ids[j] = -1
            k = after[i] = after[j]
            # Three leaves change: j's pair is gone, i's and its predecessor's pairs are new.
            at = size + i
            tree[at] = none
            if k < n:
                before[k] = i
                r = rank(new << bits | ids[k])
                if r is not None:
                    tree[at] = r << shift | i
                other = size + j
                tree[other] = none
                while other > 1:
                    left, right = tree[other], tree[other ^ 1]
                    other >>= 1
                    tree[other] = left if left < right else right
            while at > 1:
                left, right = tree[at], tree[at ^ 1]
                at >>= 1
                tree[at] = left if left < right else right
            h = before[i]
            if h >= 0:
                r = rank(ids[h] << bits | new)
                at = size + h
                tree[at] = none if r is None else r << shift | h
                while at > 1:
                    left, right = tree[at], tree[at ^ 1]
                    at >>= 1
                    tree[at] = left if left < right else right
            least = tree[1]
        return [x for x in ids if x >= 0]

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many pretokens, one after another, and how many each has."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(n) - n
        ids = self.symbols[data]
        # A tree has a leaf for each symbol and one before them: n.bit_length() levels.
        depth = np.where(n > 1, np.frexp(n)[1], 0)
        for d in np.unique(depth[depth > 0]).tolist():
            rows = np.flatnonzero(depth == d)
            if len(rows) < FEW or d > DEEP:
                for i in rows.tolist():
                    found = self.merge(words[i])
                    ids[start[i] : start[i] + n[i]] = self.outside
                    ids[start[i] : start[i] + len(found)] = found
                continue
            for k in range(0, len(rows), LEAVES >> d):
                part = rows[k : k + (LEAVES >> d)]
                self._merge_rows(data, ids, start[part], n[part], d)
        kept = ids != self.outside
        ends = np.append(0, np.cumsum(kept))
        return ids[kept].astype(np.int32), ends[start + n] - ends[start]

    def _merge_rows(self, data: np.ndarray, out: np.ndarray, start: np.ndarray, n: np.ndarray, depth: int) -> None:
        """Merges pretokens of fewer than 2 ** depth bytes, a row each; what is merged away is outside in out."""
        leaves, none = 1 << depth, len(self.made) << depth
        width = leaves + 1
        # A row's symbols have places 1 to n; there is none at the places 0 and n + 1.
        place = np.arange(width)
        inside = (place > 0) & (place <= n[:, None])
        source = (start[:, None] + place - 1)[inside]
        letters = np.full(inside.shape, 256, np.int64)
        letters[inside] = data[source]
        ids = self.symbols[letters]
        # As in merge: a leaf holds rank << depth | place.
        tree = np.empty((len(n), 2 * leaves), np.int64)
        tree[:, leaves:] = self.byte_ranks[letters[:, :-1] * 257 + letters[:, 1:]] << depth | place[:-1]
        at = leaves
        while at > 1:
            np.minimum(tree[:, at : 2 * at : 2], tree[:, at + 1 : 2 * at : 2], out=tree[:, at >> 1 : at])
            at >>= 1
        after, before = np.tile(place + 1, len(n)), np.tile(place - 1, len(n))
        tree, ids = tree.ravel(), ids.ravel()
        t, s = np.arange(len(n)) * 2 * leaves, np.arange(len(n)) * width
        while True:
            least = tree[t + 1]
            live = least < none
            t, s, least = t[live], s[live], least[live]
            if not len(t):
                break
            i, new = least & leaves - 1, self.results[least >> depth]
            j, h = after[s + i], before[s + i]
            k = after[s + j]
            ids[s + i], ids[s + j] = new, self.outside
            after[s + i], before[s + k] = k, i
            ranks = self.pair_ranks(np.concatenate([ids[s + h], new]), np.concatenate([new, ids[s + k]]))
            # Three leaves change: the predecessor's and i's pairs are new, j's pair is gone.
            hi = np.concatenate([h, i])
            at, top = np.concatenate([hi, j]) + leaves, np.concatenate([t, t, t])
            tree[top + at] = np.concatenate([ranks << depth | hi, np.full(len(t), none)])
            for _ in range(depth):
                at >>= 1
                below = top + 2 * at
                tree[top + at] = np.minimum(tree[below], tree[below + 1])
        out[source] = ids.reshape(-1, width)[inside]

    def _learn(self) -> None:
        """Merges the pretokens that came for the first time."""
        fresh = self.known.fresh
        if not fresh:
            return
        words = [w.encode("utf-8", "surrogatepass") for w in fresh]
        ids, size = self.merge_all(words)
        if self.special and not self.special.keys().isdisjoint(fresh):
            cut = np.split(ids, np.cumsum(size)[:-1])
            cut = [np.array([self.special[w]], np.int32) if w in self.special else x for w, x in zip(fresh, cut, strict=True)]
            ids, size = np.concatenate(cut), np.fromiter(map(len, cut), np.int64, len(cut))
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, ids)
        self.kept_bytes += sum(map(len, words))
        fresh.clear()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, one after another, and where each text ends."""
        if len(self.known) > CACHE or self.kept_bytes > CACHED_BYTES:
            self._forget()
        words: list[str] = []
        ends, special = [], self.special
        for text in texts:
            for part in self.parts(text) if self.parts else (text,):
                # No other pretoken is like a special token, as texts are cut at these.
                words += (part,) if part in special else self.pretokens(part)
            ends.append(len(words))
        numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        self._learn()
        total = np.append(0, np.cumsum(self.size[numbers]))
        cuts = (numbers[k : k + EXPANDED] for k in range(0, len(numbers), EXPANDED))
        ids = [runs(self.ids, self.start[x], self.size[x]) for x in cuts]
        return np.concatenate(ids) if ids else np.empty(0, np.int32), total[np.array(ends, np.int64)]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids that encode_all made."""
        total = np.append(0, np.cumsum(self.token_size[ids]))
        cuts = (ids[k : k + EXPANDED] for k in range(0, len(ids), EXPANDED))
        data = b"".join(runs(self.token_bytes, self.token_start[x], self.token_size[x]).tobytes() for x in cuts)
        bounds = [0, *total[ends].tolist()]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        known = self.bytes_of
        return b"".join([known[i] for i in ids if 0 <= i < len(known)]).decode("utf-8", "replace")


def load(docs: DataFrame, path: str):
    """The tokenizer at path (read on the driver), broadcast."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(SegmentTreeBpe(f.read()))


def groups(texts: list[bytes | None]) -> Iterator[list[str]]:
    """The texts in order, some TOGETHER at a time."""
    group, size = [], 0
    for data in texts:
        group.append(data.decode("utf-8", "replace") if data else "")
        size += len(group[-1])
        if size >= TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def encoded(bpe: SegmentTreeBpe, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each group: its ids, where each text ends, and the ids of each text."""
    for group in groups(texts):
        ids, ends = bpe.encode_all(group)
        yield ids, ends, np.split(ids, ends[:-1])


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, carried columns, ids, decoded (the text made of these ids)."""
    shared = load(docs, path)

    def rows(texts):
        i, bpe = 0, shared.value
        for ids, ends, cut in encoded(bpe, texts):
            for own, text in zip(cut, bpe.decode_all(ids, ends), strict=True):
                yield i, own, text
                i += 1

    return map_texts(docs, id_col, text_col, [("ids", "array<int>"), ("decoded", "string")], rows, carry)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per row of docs: id_col, carried columns, ids."""
    shared = load(docs, path)

    def rows(texts):
        yield from enumerate(own for _, _, cut in encoded(shared.value, texts) for own in cut)

    return map_texts(docs, id_col, text_col, [("ids", "array<int>")], rows, carry)


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row: id_col, text; null ids give an empty text."""
    from pyspark.sql import functions as F

    shared = load(encoded, path)

    @F.pandas_udf("string")
    def text(ids):
        return ids.map(lambda x: shared.value.decode([int(i) for i in x if i is not None]) if x is not None else "")

    return encoded.select(id_col, text(ids_col).alias("text"))
