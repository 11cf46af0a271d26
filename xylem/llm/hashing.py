"""Fingerprints of many substrings at once, from prefix sums of polynomial hashes modulo 2^64."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a well-known 64-bit generator; spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def random64(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x632BE59BD9B4E019 & _MASK))


BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)
BYTES = tuple(random64(256, s) for s in (1, 2))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())

        def grow(b: int) -> np.ndarray:
            out, m = np.ones(size, np.uint64), 1
            while m < size:
                out[m : 2 * m] = out[:m] * np.uint64(pow(b, m, 1 << 64))
                m *= 2
            return out

        have = _powers[base] = (grow(base), grow(pow(base, -1, 1 << 64)))
    return have


class Prefixes:
    """Hashes of substrings [a, b) of an array of bytes, or of 64-bit numbers; equal parts give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = powers(BASES[which], len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        codes = BYTES[which][data] if data.dtype == np.uint8 else mix(data + BYTES[which][0])
        np.cumsum(codes * up[: len(data)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + np.uint64(0x9E3779B97F4A7C15) * (b - a).astype(np.uint64))

    def runs(self, size: int) -> np.ndarray:
        """A hash of each substring of ``size``, by its start; the high bits are those to use."""
        out = self.sums[size:] - self.sums[:-size]
        out *= self.down[: len(out)]
        return out
