"""The binary Golay code [23, 12, 7]: perfect, so every 23-bit word is within distance 3 of exactly one codeword."""

from __future__ import annotations

from functools import cache

import numpy as np

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101
BITS, INDEX_BITS = 23, 12


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of the polynomials by the generator; zero for codewords."""
    left = np.asarray(words, np.int64).copy()
    for bit in range(BITS - 1, BITS - INDEX_BITS - 1, -1):
        left ^= np.where(left >> bit & 1, GENERATOR << (bit - 11), 0)
    return left


@cache
def corrections() -> np.ndarray:
    """The error of at most three bits for each of the 2048 remainders."""
    ones = 1 << np.arange(BITS, dtype=np.int64)
    two = np.array([a | b for i, a in enumerate(ones) for b in ones[:i]])
    three = np.array([a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j]])
    errors = np.concatenate([[0], ones, two, three])
    table = np.zeros(1 << 11, np.int64)
    table[syndrome(errors)] = errors
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Index (the upper 12 bits) of the codeword nearest to each word."""
    words = np.asarray(words, np.int64)
    return (words ^ corrections()[syndrome(words)]) >> (BITS - INDEX_BITS)


def near(words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Indices of the words with none or one of their lower ``bits`` flipped, a row of 1 + bits each, with repeats.

    At most six differ: flips of a word within distance 2 of its codeword change nothing, the others fall to one of
    five more codewords. Words one bit apart have at least the indices of both in common.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    return decode(np.asarray(words, np.int64)[:, None] ^ flips)
