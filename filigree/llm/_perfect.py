"""Minimal perfect hashing: n keys to the numbers 0 to n - 1, each looked up in constant time, unknown keys told by fingerprints.

Keys are known by 128-bit digests. A level is a bit array twice as long as the keys that are left; keys that are alone at
their place there set its bit and are settled, the others go on to the next level. A key's number is the count of bits
set before its own. About 4 bits a key, 1.6 levels looked at on average.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np

from filigree.llm._words import mix

U = np.uint64
#: Levels, at most: of n different digests, some are left with a probability of about n / 2^64.
MOST = 96


def digests(keys: Iterable[bytes]) -> np.ndarray:
    """n x 2 64-bit numbers."""
    joined = b"".join(hashlib.blake2b(k, digest_size=16).digest() for k in keys)
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def fingerprints(d: np.ndarray) -> np.ndarray:
    return (mix(d[:, 1] ^ U(0xA5A5A5A5A5A5A5A5)) >> U(32)).astype(np.uint32)


def _places(d: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(d[:, 0] + U(level) * (d[:, 1] | U(1))) % U(size)).astype(np.int64)


class Perfect:
    """The function of given level sizes and bits."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.packed = sizes, bits
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").astype(bool)
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(self.bits)))

    @classmethod
    def of(cls, d: np.ndarray) -> Perfect:
        """Of different digests; equal ones raise."""
        left, sizes, parts = d, [], []
        while len(left):
            if len(sizes) == MOST:
                raise ValueError("equal keys")
            size = -(-2 * len(left) // 8) * 8
            at = _places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").tobytes())
            left = left[~alone[at]]
        return cls(sizes, b"".join(parts))

    def __call__(self, d: np.ndarray) -> np.ndarray:
        """Numbers of digests; of an unknown one, any number or -1."""
        out, left = np.full(len(d), -1, np.int64), np.arange(len(d))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = self.starts[level] + _places(d[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.before[at[hit]]
            left = left[~hit]
        return out
