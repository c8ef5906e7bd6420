"""Words of a text as 64-bit hashes with their byte offsets, in whole-array operations.

Bytes of letters and digits (all of non-ASCII) are word bytes, A-Z count as a-z, everything else separates. A word's
hash is a difference of prefix sums of byte values times powers of an odd number, modulo 2^64, then mixed.
"""

from __future__ import annotations

import numpy as np

_R = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_R), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)[_LOWER] | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        _powers[0], _powers[1] = _R ** np.arange(size, dtype=np.uint64), _INVERSE ** np.arange(size, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: bytes, word_bytes: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start offsets, end offsets, hashes) of the words of UTF-8 bytes; word_bytes: which of the 256 bytes words consist of."""
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[False], word_bytes[b], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    power, inverse = _grow(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[b] * power[: len(b)])])
    return start, end, mix((total[end] - total[start]) * inverse[start])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _R + hashes[i : i + n]
    return mix(out)


def sequences(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in a row, for long rows: in as many steps whatever k is."""
    n = len(hashes) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, inverse = _grow(len(hashes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[: len(hashes)])])
    return mix((total[k:] - total[:n]) * inverse[:n])
