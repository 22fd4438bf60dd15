"""The perfect binary Golay code of 23 bits, and keys of fingerprints by its codewords.

Every word of 23 bits is within three bits of exactly one codeword, so ``nearest`` is a function. ``within``
gives all codewords at most four bits away, one or six of them. For two words that differ

* in one bit, the codeword nearest to either is within four of the other;
* in at most two bits, the codeword nearest to the word halfway is within four of both.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0xAE3  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, CHECK_BITS = 23, 11


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


_CHECKS = np.array([_remainder(i << CHECK_BITS) for i in range(1 << (LENGTH - CHECK_BITS))], dtype=np.int64)


def _syndrome(words: np.ndarray) -> np.ndarray:
    return (words & ((1 << CHECK_BITS) - 1)) ^ _CHECKS[words >> CHECK_BITS]


def _errors() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome the error patterns of at most four bits, the lightest first, and how many there are."""
    found: list[list[int]] = [[] for _ in range(1 << CHECK_BITS)]
    for weight in range(5):
        for bits in combinations(range(LENGTH), weight):
            error = sum(1 << b for b in bits)
            found[int(_syndrome(np.array(error)))].append(error)
    counts = np.array([len(f) for f in found])
    table = np.zeros((len(found), counts.max()), dtype=np.int64)
    for i, f in enumerate(found):
        table[i, : len(f)] = f
    return table, counts


_ERRORS, _COUNTS = _errors()


def nearest(words: np.ndarray) -> np.ndarray:
    """The number (12 bits) of the codeword within three bits."""
    return (words ^ _ERRORS[_syndrome(words), 0]) >> CHECK_BITS


def within(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codewords within four bits, a row for each word, and which places of the row are taken."""
    s = _syndrome(words)
    return (words[:, None] ^ _ERRORS[s]) >> CHECK_BITS, np.arange(_ERRORS.shape[1]) < _COUNTS[s][:, None]


SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and bits of the three parts of a fingerprint


def _pairs(at: np.ndarray, left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Each row's combinations of two sets of numbers, as rows of one number of 24 bits."""
    both = left[1][:, :, None] & right[1][:, None, :]
    row, i, j = np.nonzero(both)
    return at[row], left[0][row, i] << 12 | right[0][row, j]


def keys(fingerprints: np.ndarray, third: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys: fingerprints (unsigned) that differ in at most four bits share a key.

    Four errors in three segments leave one of two cases. A segment without errors and another with at most
    two: they share the exact segment and a codeword of the other. Or no segment without errors, then two
    with exactly one each: one of the fingerprints takes the part of its nearest codeword in the first and
    of those within four bits in the second, the other the reverse, and parities differ. ``third`` adds a
    codeword of the last segment, which holds at most two errors then, to the second case: about five
    times its keys, each 800 times rarer.
    """
    n = len(fingerprints)
    at = np.arange(n)
    parts = [((fingerprints >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    near = [nearest(p) for p in parts]
    close = [within(p) for p in parts]
    odd = [(np.bitwise_count(p) & 1).astype(np.int64) for p in parts]
    rows, out = [], []
    case = 0
    for x in range(3):
        for y in range(3):
            if x != y:
                row, j = np.nonzero(close[y][1])
                rows.append(row)
                out.append((case << 34) | parts[x][row] << 12 | close[y][0][row, j])
                case += 1
    for x, y in combinations(range(3), 2):
        z = 3 - x - y
        for flip in (0, 1):
            one, many = (x, y) if not flip else (y, x)
            if third:
                row, j = _pairs(at, close[many], close[z])
                other, extra = j >> 12, j & 0xFFF
            else:
                row, j = np.nonzero(close[many][1])
                other, extra = close[many][0][row, j], np.zeros(len(row), dtype=np.int64)
            first, second = (near[one][row], other) if not flip else (other, near[one][row])
            parity = (odd[x][row] ^ flip) << 1 | (odd[y][row] ^ flip)
            rows.append(row)
            out.append((case << 38) | extra << 26 | parity << 24 | first << 12 | second)
        case += 1
    return np.concatenate(rows), np.concatenate(out)
