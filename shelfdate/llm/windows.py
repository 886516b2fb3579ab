"""Word hashes and rolling (Rabin-Karp) hashes of word windows, for use inside tasks."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import remembers

#: Odd bases of the two rolling polynomials and the finishing multiplier (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
FINISH = 0xFF51AFD7ED558CCD
REMEMBERED = 250_000


class WordHash(dict):
    """64-bit hash of a word's bytes, remembered; starts afresh when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        told = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return told

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


word_hash = remembers("windows", WordHash())


def finish(x: np.ndarray) -> np.ndarray:
    """Spreads differences over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(FINISH)
    return x ^ (x >> np.uint64(33))


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every window of `width` words modulo 2**64: one step takes the next word in and, as the
    difference of two prefix sums, the oldest out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers, inverse = (np.full(len(words), b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    powers[0] = inverse[0] = 1
    powers, inverse = np.cumprod(powers), np.cumprod(inverse)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * inverse)))
    return finish((sums[width:] - sums[:-width]) * powers[:n])
