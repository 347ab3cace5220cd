"""Hashes of the words of many texts at once, without a Python object for a word.

The words are those of ``common.alnum_words``. A word's hash is a polynomial of
keyed byte values modulo 2**64, taken from running sums over the bytes of a block
of texts, and mixed. 64 bits keep words apart: two given words fall together with
odds of about 2**-63.
"""

from __future__ import annotations

import numpy as np

from figureyard.llm.common import ALNUM

BLOCK = 1 << 20  # bytes hashed together, if no word is longer
BASE = 0x9E3779B97F4A7C15
UNDO = pow(BASE, -1, 1 << 64)
VALUES = np.random.default_rng(20260301).integers(1, 2**63, 256, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


_known = [powers(BASE, BLOCK), powers(UNDO, BLOCK)]


def of_ranges(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [begin, end) of ``x``."""
    n = len(x)
    if n >= len(_known[0]):
        times, undo = powers(BASE, n), powers(UNDO, n)
    else:
        times, undo = _known
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(VALUES[x] * times[:n], out=sums[1:])
    h = (sums[end] - sums[begin]) * undo[begin]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def of_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of ``data``, which ALNUM has translated."""
    x = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[False, x != 32, False]))
    return of_ranges(x, edge[::2], edge[1::2]), edge[::2]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    whole = b" ".join(data).translate(ALNUM)
    found, places, at = [], [], 0
    while at < len(whole):
        to = at + BLOCK
        if to < len(whole):
            cut = whole.rfind(b" ", at, to)
            if cut <= at:
                cut = whole.find(b" ", at + 1)
            to = cut if cut > 0 else len(whole)
        h, begin = of_block(whole[at:to])
        found.append(h)
        places.append(begin + at)
        at = to
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = np.searchsorted(np.concatenate(places), np.r_[0, ends])
    return np.concatenate(found), np.diff(starts)
