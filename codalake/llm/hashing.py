"""Word and shingle hashes of whole batches of texts, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
#: Bytes hashed at a time: the working arrays take some 60 times as much.
PART = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=U) + U(seed) * U(1_000_003)) * U(0x9E3779B97F4A7C15))


#: Longer words are hashed one by one.
LONG_WORD = 64
_ALL = U(0xFFFFFFFFFFFFFFFF)


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of data: a bijective mixer chained over blocks of 8 bytes, so that spans of one
    length up to 8 bytes never agree and longer ones by chance only; BLAKE2b beyond LONG_WORD bytes."""
    size = ends - starts
    blocks = np.ndarray((len(data) + 1,), U, data + bytes(8), strides=(1,))
    with np.errstate(over="ignore"):
        h = mixed(size.astype(U) + U(0x2545F4914F6CDD1D))
        left, at = np.arange(len(size)), starts
        for done in range(0, LONG_WORD, 8):
            rest = size[left] - done
            if done:
                go = rest > 0
                left, rest = left[go], rest[go]
                at = starts[left] + done
            if not len(left):
                break
            block = blocks[at] & (_ALL >> (U(8) * (U(8) - np.clip(rest, 1, 8).astype(U))))
            h[left] = mixed(h[left] ^ block)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def word_hashes(data: bytes, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word, and where each begins. space: for each byte value, whether it parts words."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~space[np.frombuffer(data, np.uint8)]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return span_hashes(data, starts, ends), starts


# Fixed value: the bytes that part words in near-duplicate detection.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _parts(texts: list[bytes | None]):
    """Runs of texts of some PART bytes together."""
    part, size = [], 0
    for t in texts:
        t = t or b""
        if part and size + len(t) > PART:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 1
    if part:
        yield part


def shingle_sets(texts: list[bytes | None], k: int = 3):
    """For each text the sorted distinct hashes of its k-word shingles; of the whole sequence if it has fewer words; empty without words."""
    factors = numbers(k, 2) | U(1)
    for part in _parts(texts):
        hashes, starts = word_hashes(b" ".join(part).lower(), _SPACE)
        first = np.cumsum([0, *(len(t) + 1 for t in part)])
        at = np.searchsorted(starts, first)
        with np.errstate(over="ignore"):
            n = max(0, len(hashes) - k + 1)
            whole = np.zeros(n, U)
            for i in range(k):
                whole += hashes[i : i + n] * factors[i]
            whole = mixed(whole)
            for a, b in zip(at, at[1:], strict=False):
                if b - a >= k:
                    yield np.unique(whole[a : b - k + 1])
                elif b > a:
                    yield mixed(np.array([(hashes[a:b] * factors[: b - a]).sum(dtype=U) + U(b - a)], U))
                else:
                    yield np.zeros(0, U)


class MinHasher:
    """Signatures of n 32-bit minima."""

    def __init__(self, n: int, seed: int = 3):
        self.n, self.a, self.b = n, (numbers(n, seed) | U(1))[:, None], numbers(n, seed + 1)[:, None]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(self.n, 0xFFFFFFFF, np.uint32)
        with np.errstate(over="ignore"):
            for i in range(0, len(x), 1024):
                h = self.a * x[i : i + 1024]
                h += self.b
                h >>= U(32)
                np.minimum(out, h.min(axis=1).astype(np.uint32), out=out)
        return out
