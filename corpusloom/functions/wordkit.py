"""Words, word hashes and word sequences of a batch of texts as flat numpy arrays.

A word is a longest run of letters and digits, lower-cased. The word hash is a 64-bit xxHash of its
UTF-8 form; a sequence of n words is hashed by a polynomial in the word hashes and then mixed.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash, computed once; emptied when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def flat_words(texts, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and the number of words of each text."""
    each = [words(t) for t in texts]
    lens = np.fromiter(map(len, each), np.int64, len(each))
    n = int(lens.sum())
    return np.fromiter(map(cache.__getitem__, chain.from_iterable(each)), np.uint64, n), lens


def sequences(h: np.ndarray, lens: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word sequences inside a text, in order, and the text's number for each."""
    doc = np.repeat(np.arange(len(lens)), lens)
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(h) - n + 1
    inside = doc[:m] == doc[n - 1 :]
    x = h[:m].copy()
    for k in range(1, n):
        x *= _BASE
        x += h[k : k + m]
    return mix(x[inside]), doc[:m][inside]


def distinct_in_text(seq: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct sequence hashes of each text (ascending), their text's number, and how many each text has.

    ``doc`` must be ascending.
    """
    if not len(seq):
        return seq, doc, np.zeros(n_docs, np.int64)
    order = np.lexsort((seq, doc))
    s, d = seq[order], doc[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[keep], d[keep]
    return s, d, np.bincount(d, minlength=n_docs)


def sliced(batches, rows: int = 2_000):
    """The same rows in smaller frames: the arrays built from a frame are many times its size."""
    for pdf in batches:
        for k in range(0, len(pdf), rows):
            yield pdf.iloc[k : k + rows].reset_index(drop=True)
