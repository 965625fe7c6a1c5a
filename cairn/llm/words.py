"""Hashes of the words of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

MULT = 0x9E3779B97F4A7C15
#: Bytes of a word up to which its hash is the sum of its bytes times powers; longer words are digested one by one.
SHORT = 256
POWERS = np.cumprod(np.full(SHORT, MULT, np.uint64), dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(whole: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of each word of ``whole``, given by where it begins and its bytes; a long word's tells all of its bytes apart."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    short = np.minimum(lengths, SHORT)
    ends = np.cumsum(short)
    begins = ends - short
    place = np.arange(ends[-1]) - np.repeat(begins, short)
    total = np.add.reduceat((whole[place + np.repeat(starts, short)].astype(np.uint64) + np.uint64(1)) * POWERS[place], begins)
    out = mix(total + lengths.astype(np.uint64))
    for i in np.flatnonzero(lengths > SHORT).tolist():
        word = whole[starts[i] : starts[i] + lengths[i]].tobytes()
        out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return out
