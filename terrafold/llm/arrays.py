"""NumPy kernels over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

U64 = np.uint64
#: An odd multiplier has an inverse modulo 2**64, so hashes of any stretch follow from one running sum.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit values for a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(BASE) + U64(seed))


TABLE = stream(1, 256)


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _enough(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


@dataclass
class Words:
    """The words of many texts: text of each word, and a 64-bit hash of its bytes."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a line feed behind each as one array, and the offsets of their starts, the end included."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.concatenate(([0], np.cumsum(sizes)))


def _pieces(texts: list[bytes], most: int) -> tuple[list[bytes], list[int]]:
    """The texts cut at white space into pieces of about `most` bytes, and the text of each piece."""
    out, of = [], []
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > most:
            cut = max(t.rfind(b" ", at, at + most), t.rfind(b"\n", at, at + most))
            if cut <= at:
                break
            out.append(t[at:cut])
            of.append(i)
            at = cut
        out.append(t[at:] if at else t)
        of.append(i)
    return out, of


def words_of(texts: list[bytes], lower: bool = True, most: int = 1 << 22) -> Words:
    """start and stop count from the start of the texts joined by a line feed; very long texts are hashed in pieces."""
    if any(len(t) > most for t in texts):
        cut, of = _pieces(texts, most)
        offsets = np.concatenate(([0], np.cumsum([len(t) + (k + 1 == len(cut) or of[k + 1] != of[k]) for k, t in enumerate(cut)])))
        parts = [(words_of([t], lower, len(t)), of[k], offsets[k]) for k, t in enumerate(cut)]
        return Words(*(np.concatenate(x) for x in zip(*((w.doc + d, w.hash, w.start + o, w.stop + o) for w, d, o in parts), strict=True)))
    data, offsets = joined(texts)
    if lower:
        data = LOWER[data]
    space = IS_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    n = _enough(len(data))
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(TABLE[data] * powers(BASE, n)[: len(data)], dtype=np.uint64)))
    value = mix((run[stop] - run[start]) * powers(INVERSE, n)[start] + (stop - start).astype(np.uint64))
    return Words(np.searchsorted(offsets, start, "right") - 1, value, start, stop)


def shingles(w: Words, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each distinct shingle of `size` words, ordered by text, then hash.

    A text with fewer words has the whole sequence as its one shingle; a text without words has none.
    """
    counts = np.bincount(w.doc, minlength=n_texts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    value = np.zeros(len(w.hash), np.uint64)
    full = np.zeros(len(w.hash), bool)
    if len(w.hash):
        place = np.arange(len(w.hash)) - first[w.doc]
        full = place + size <= counts[w.doc]
        acc, at = np.zeros(int(full.sum()), np.uint64), np.flatnonzero(full)
        for k in range(size):
            acc = mix(acc * U64(BASE) + w.hash[at + k])
        value[at] = acc
    short = np.flatnonzero((counts > 0) & (counts < size))
    extra = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short):
        acc = np.array([counts[d]], np.uint64) * U64(INVERSE)
        for h in w.hash[first[d] : first[d] + counts[d]]:
            acc = mix(acc * U64(BASE) + h)
        extra[i] = acc[0]
    hashes, docs = np.concatenate((value[full], extra)), np.concatenate((w.doc[full], short))
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return hashes[new], docs[new]


def blocks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together, a longer text alone: arrays over them stay small."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
