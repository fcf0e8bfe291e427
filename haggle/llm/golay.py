"""The perfect binary Golay code of length 23: every 23-bit word is within 3 bits of exactly one codeword.

Words x and y that differ in two bits or fewer have a codeword in common among those within 4 bits of each:
take a word m no more than one bit from both; the codeword within 3 bits of m is within 4 of x and of y.
The codewords within 4 bits of x are what x and its 23 one-bit neighbours decode to: one codeword if x is
within 2 bits of it, else six.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

LENGTH = 23
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 bits and of the high 11 bits; the error of at most 3 bits for each syndrome."""
    low = np.array([_remainder(x) for x in range(1 << 12)], np.int32)
    high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int32)
    error = np.zeros(1 << 11, np.int32)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            word = sum(1 << b for b in bits)
            error[_remainder(word)] = word
    return low, high, error


def decode(words: np.ndarray) -> np.ndarray:
    """The index (the 12 message bits) of the codeword nearest to each word."""
    low, high, error = _tables()
    return (words ^ error[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


def near(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices of all codewords within 4 bits: (row of words, index), each once."""
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)]).astype(words.dtype)
    found = np.sort(decode(words[:, None] ^ flips), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    row, col = np.nonzero(new)
    return row, found[row, col]
