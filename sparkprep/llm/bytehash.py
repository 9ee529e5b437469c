"""Vectorised substring hashes of a byte buffer.

``Prefix`` holds a polynomial prefix sum modulo 2**64 over a random value per
byte, so the hash of any substring takes three array reads.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and odd multipliers)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class Hasher:
    """Byte values and powers of one odd base; equal seeds give equal hashes."""

    def __init__(self, seed: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self.base = int(rng.integers(1, 2**62, dtype=np.uint64)) * 4 + 3
        self.inverse_base = pow(self.base, -1, 2**64)
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) >= n:
            return
        size = max(n, 2 * len(self.powers))
        self.powers = self._series(self.base, size)
        self.inverses = self._series(self.inverse_base, size)

    @staticmethod
    def _series(base: int, size: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < size:
            out = np.concatenate([out, out * _U(pow(base, len(out), 2**64))])
        return out[:size]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of every substring [start, end)."""
        return (prefix[end] - prefix[start]) * self.inverses[start]
