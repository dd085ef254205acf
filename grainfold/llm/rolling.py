"""Hashes of any stretch of texts, by sums over code points."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0xC2B2AE3D27D4EB4F)
INVERSE = U(pow(int(BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Rolling:
    """Hashes of any stretch of a chunk of code points."""

    powers = inverses = np.ones(1, U)

    def __init__(self, texts: list[str]) -> None:
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n = len(self.cp)
        if len(Rolling.powers) <= n:
            Rolling.powers = np.concatenate([np.ones(1, U), np.cumprod(np.full(2 * n, BASE))])
            Rolling.inverses = np.concatenate([np.ones(1, U), np.cumprod(np.full(2 * n, INVERSE))])
        self.sums = np.zeros(n + 1, U)
        np.cumsum((self.cp + U(0x9E3779B1)) * (self.cp + U(0x85EBCA77)) * Rolling.powers[:n], out=self.sums[1:])

    def stretch(self, start: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * Rolling.inverses[start] + U(length))

    def grams(self, length: int) -> np.ndarray:
        """Of every start at once."""
        n = len(self.cp) - length + 1
        return mix((self.sums[length:] - self.sums[:n]) * Rolling.inverses[:n] + U(length))
