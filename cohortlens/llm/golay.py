"""The perfect binary Golay code (23 bits, 12 of them data) and fuzzy keys from it."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, DATA = 23, 12
CHECK = LENGTH - DATA
# Fixed value: the code's generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error of each remainder.

    The code is perfect: every remainder belongs to exactly one error of three bits or fewer.
    """
    low = np.array([_remainder(v) for v in range(1 << 12)], np.uint32)
    high = np.array([_remainder(v << 12) for v in range(1 << 11)], np.uint32)
    error = np.zeros(1 << CHECK, np.uint32)
    for weight in range(4):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            error[_remainder(word)] = word
    return low, high, error


def nearest(words: np.ndarray) -> np.ndarray:
    """Index (0..4095) of the codeword within three bits of each 23-bit word."""
    low, high, error = _tables()
    remainder = low[words & 0xFFF] ^ high[words >> 12]
    return (words ^ error[remainder]) >> CHECK


# Bits of a 64-bit fingerprint in each segment, and the parts of the bits outside of one.
WIDTHS = (22, 21, 21)
PARTS = 5
_KINDS = 32


def _slices(values: np.ndarray, start: int, width: int) -> np.ndarray:
    return values >> np.uint64(start) & np.uint64((1 << width) - 1)


def _without(values: np.ndarray, start: int, width: int) -> np.ndarray:
    """The bits outside a segment, closed up."""
    above = values >> np.uint64(start + width) if start + width < 64 else np.zeros_like(values)
    return above << np.uint64(start) | _slices(values, 0, start)


def _indexed(words: np.ndarray) -> np.ndarray:
    """Codeword index and parity of 23-bit words, 13 bits."""
    return nearest(words).astype(np.int64) << 1 | np.bitwise_count(words) & 1


def fuzzy_keys(fingerprints: np.ndarray, tag: int = 0) -> list[np.ndarray]:
    """Keys of each 64-bit fingerprint; two that differ in four bits or fewer share one.

    Errors are divided by pigeonholes. Of three segments, either one has no error: then the
    four errors leave one of ``PARTS`` parts of the other bits without any, and segment and
    part are a key. Or each has one: then two segments have exactly one, for with a third the
    errors would be five. For these, each pair of segments gives the codeword indices of both,
    one of them with each of its bits turned in turn. The words are decoded, so that the many
    turned words fall to six codewords at most; turning the one wrong bit makes the segment of
    one fingerprint that of the other, whose key has the turned bit in the other segment. The
    parity of the words is part of the key. Keys of other pairs, segments, parts, and ``tag``
    values never meet.
    """
    if not len(fingerprints):
        return []
    values = fingerprints.astype(np.int64).view(np.uint64)
    starts = [sum(WIDTHS[:k]) for k in range(len(WIDTHS))]
    parts = [_slices(values, start, width) for start, width in zip(starts, WIDTHS)]
    found, kind = [], tag * _KINDS
    for part, start, width in zip(parts, starts, WIDTHS):
        rest, size = _without(values, start, width), 64 - width
        cuts = [round(size * k / PARTS) for k in range(PARTS + 1)]
        for low, high in zip(cuts, cuts[1:]):
            exact = part << np.uint64(9) | _slices(rest, low, high - low)
            found.append((exact.astype(np.int64) | kind << 32)[:, None])
            kind += 1
    words = [part.astype(np.uint32) for part in parts]
    plain = [_indexed(word)[:, None] for word in words]
    turned = [
        _indexed(word[:, None] ^ np.array([1 << b for b in range(width)], np.uint32))
        for word, width in zip(words, WIDTHS)
    ]
    for i, j in combinations(range(len(WIDTHS)), 2):
        for left, right in ((turned[i], plain[j]), (plain[i], turned[j])):
            found.append(left << DATA + 1 | right | kind << 32)
        kind += 1
    return [np.unique(row) for row in np.concatenate(found, axis=1)]
