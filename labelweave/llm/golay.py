"""The binary Golay code [23, 12]: every 23-bit word is within 3 bits of one codeword."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
GENERATOR = 0xC75  # fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
NONE = -1
MOST = 6  # codewords near a word, see neighbours()


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each single bit; error pattern of each remainder."""
    columns = np.array([_remainder(1 << b) for b in range(LENGTH)])
    errors = np.zeros(1 << CHECKS, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            errors[np.bitwise_xor.reduce(columns[list(bits)])] = sum(1 << b for b in bits)
    return columns, errors


def neighbours(words: np.ndarray) -> np.ndarray:
    """12-bit indices of the codewords that words within one bit decode to.

    An array of ``MOST`` columns, filled up with ``NONE``: a word three bits
    off its codeword has six, any other one. Words that differ in two bits or
    fewer have a word within one bit of both, so they share an index.
    """
    columns, errors = _tables()
    words = words.astype(np.int64)
    remainder = np.zeros(len(words), np.int64)
    for bit in range(LENGTH):
        remainder ^= np.where(words >> bit & 1, columns[bit], 0)
    flips = np.r_[0, columns]
    flipped = np.r_[0, 1 << np.arange(LENGTH)]
    index = np.empty((len(words), LENGTH + 1), np.int64)
    for k in range(LENGTH + 1):
        index[:, k] = (words ^ flipped[k] ^ errors[remainder ^ flips[k]]) >> CHECKS
    index.sort(axis=1)
    fresh = np.c_[np.ones(len(words), bool), index[:, 1:] != index[:, :-1]]
    out = np.full((len(words), MOST), NONE)
    row, col = np.nonzero(fresh)
    out[row, np.cumsum(fresh, axis=1)[row, col] - 1] = index[row, col]
    return out
