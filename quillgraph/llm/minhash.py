"""Shingle sets, MinHash bands and odd sketches of one text, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from .common import held, space_words

WIDTH = 5
SAMPLES, ROWS = 128, 4
BANDS = SAMPLES // ROWS
SKETCH_BITS = 512
#: Words of a worker's table of word hashes.
TABLE_SIZE = 200_000

_rng = np.random.default_rng(20240229)
_MULTIPLIERS = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_BAND_SALT = _rng.integers(1, 2**63, BANDS, dtype=np.uint64)
_SAMPLE_SALT = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash, bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= TABLE_SIZE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes; one for the whole sequence of fewer words, none without words."""
    words = space_words(text)
    if not words:
        return np.empty(0, np.uint64)
    hashes = held("minhash", WordHashes)
    h = np.array([hashes[w] for w in words], np.uint64)
    size = min(width, len(h))
    key = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        key = key * _STEP + h[i : len(h) - size + 1 + i]
        key ^= key >> np.uint64(29)
    return np.unique(mixed(key))


def fingerprint(own: np.ndarray) -> bytes:
    """128 bits of the set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def samples(own: np.ndarray) -> np.ndarray:
    """The least value of each of SAMPLES hash functions over the set."""
    low = np.full(SAMPLES, np.uint64(2**64 - 1), np.uint64)
    for i in range(0, len(own), 256):
        values = own[i : i + 256, None] * _MULTIPLIERS + _OFFSETS
        values ^= values >> np.uint64(32)
        low = np.minimum(low, values.min(axis=0))
    return low


def bands(low: np.ndarray) -> np.ndarray:
    """One key for each band of ROWS samples."""
    key = _BAND_SALT.copy()
    for column in mixed(low).reshape(BANDS, ROWS).T:
        key = mixed(key * _STEP + column)
    return key.view(np.int64)


def odd_sketch(low: np.ndarray) -> bytes:
    """A bitmap: each sample flips one bit, so a bit tells the parity of the samples that fall there."""
    at = (mixed(low ^ _SAMPLE_SALT) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=SKETCH_BITS) & 1).astype(np.uint8)).tobytes()


def estimate(flipped: np.ndarray) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR: that of their differing samples, by the parity occupancy."""
    share = np.minimum(2.0 * flipped / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / (4.0 * SAMPLES) * np.log(1 - share)


def population(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits set in the XOR of rows of packed sketches (uint8)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
