"""Words and shingle hashes of one text, for use inside tasks."""

from __future__ import annotations

from itertools import accumulate, chain

import numpy as np
import xxhash

# Space, tab, line feed, vertical tab, form feed and carriage return part words.
WHITESPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded_words(text: str | None) -> list[bytes]:
    """UTF-8 words between ASCII white space, A-Z lower-cased; none for a null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(text: str | None, size: int, seed: int = 42, distinct: bool = False) -> np.ndarray:
    """XXH64 of every run of ``size`` words joined by spaces, as unsigned 64-bit numbers.

    A text of fewer words has its whole sequence as the one shingle, a text of none has none.
    """
    words = folded_words(text)
    if not words:
        return np.empty(0, np.uint64)
    if size == 1:
        pieces = set(words) if distinct else words
        return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in pieces), np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    spans = zip(chain((0,), ends), ends[size - 1 :])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a : b - 1], seed) for a, b in spans), np.uint64, len(words) - size + 1)
    return np.unique(hashes) if distinct else hashes
