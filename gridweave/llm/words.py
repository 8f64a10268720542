"""Words between ASCII white space and 64-bit hashes of them, for code that runs on executors."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: An odd multiplier for polynomials over word hashes, modulo 2^64; and another for a second, independent one.
BASE, BASE2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MASK = (1 << 64) - 1


def split(text: str | None) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+``: what bytes.split() does, without Unicode's other white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class Hashes(dict):
    """Hash by word; forgets all when it has grown to ``most`` words, so that a worker's memory is bounded."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits (the finaliser of splitmix64), so that order by hash is as good as random."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def grams(h: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Unmixed hashes of the runs of ``n`` words, by doubling: each step joins two runs that are known."""
    if len(h) < n:
        return h[:0]
    out, have, runs, size = None, 0, h, 1
    rest = n
    while rest:
        if rest & 1:  # append a run of ``size`` words to the ``have`` words so far
            m = len(h) - (have + size) + 1
            piece = runs[have : have + m]
            out = piece.copy() if out is None else out[:m] + piece * U64(pow(base, have, 1 << 64))
            have += size
        rest >>= 1
        if rest:
            runs = runs[: len(runs) - size] + runs[size:] * U64(pow(base, size, 1 << 64))
            size *= 2
    return out
