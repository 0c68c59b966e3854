"""The binary Golay code (23, 12): every 23-bit word lies within three errors of exactly one codeword.

The indices of the codewords nearest to all words of the unit ball around a word are its fuzzy keys: one key if the
word is within two errors of a codeword, else six. Two words at distance two or less have a word in the
middle, at distance one or less from both, and so share a key.
"""

from __future__ import annotations

from functools import cache

import numpy as np

LENGTH, DATA_BITS = 23, 12
CHECK_BITS = LENGTH - DATA_BITS
#: The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECK_BITS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The remainder of each value of each of a word's three bytes, and the error pattern of each remainder."""
    unit = [_remainder(1 << bit) for bit in range(LENGTH)] + [0]
    parts = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1:
                    parts[byte, value] ^= unit[8 * byte + bit]
    errors = np.zeros(1 << CHECK_BITS, np.int64)
    for a in range(LENGTH):
        errors[unit[a]] = 1 << a
        for b in range(a):
            errors[unit[a] ^ unit[b]] = 1 << a | 1 << b
            for c in range(b):
                errors[unit[a] ^ unit[b] ^ unit[c]] = 1 << a | 1 << b | 1 << c
    return parts, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    parts, errors = _tables()
    syndrome = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16 & 255]
    return (words ^ errors[syndrome]) >> CHECK_BITS


def ball_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """An array (words, 1 + bits): the index of each word, then of the word with each of its lowest bits flipped."""
    flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
    return decode(words[:, None] ^ flips[None, :])
