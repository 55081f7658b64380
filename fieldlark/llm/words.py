"""Words of a text and 64-bit hashes of word sequences, a whole text at a time in numpy.

A word is a run of ASCII letters and digits and of all characters beyond ASCII,
with A-Z lower-cased: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. On UTF-8 bytes this is
one translation table and one split.
"""

from __future__ import annotations

import numpy as np

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normal_bytes(text: str | None) -> bytes:
    """The words of *text*, joined by single spaces, as UTF-8."""
    if not text:
        return b""
    return b" ".join(text.encode("utf-8", "replace").translate(_TABLE).split())


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer: a one-to-one map of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class SpanHasher:
    """Hashes of byte spans of one text: sum of a random value per byte times a power of an odd base, mod 2**64.

    Equal spans have equal hashes wherever they stand; one cumulative sum serves all spans of a text.
    """

    def __init__(self, seed: int = 1):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.values = draw.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = int(draw.integers(2**40, 2**62)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), 1 << 14)
            with np.errstate(over="ignore"):
                for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                    x = np.full(n, factor, np.uint64)
                    x[0] = 1
                    setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prefix sums, starts, ends) of the words of normalised *data*."""
        raw = np.frombuffer(data, np.uint8)
        self.grow(len(raw) + 1)
        sums = np.empty(len(raw) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[raw] * self.powers[: len(raw)], out=sums[1:])
        gaps = np.flatnonzero(raw == 32)
        starts, ends = np.empty(len(gaps) + 1, np.int64), np.empty(len(gaps) + 1, np.int64)
        starts[0], starts[1:] = 0, gaps + 1
        ends[-1], ends[:-1] = len(raw), gaps
        return sums, starts, ends

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverses[starts])


def word_hashes(hasher: SpanHasher, data: bytes) -> np.ndarray:
    """One hash per word of normalised *data*."""
    if not data:
        return np.empty(0, np.uint64)
    sums, starts, ends = hasher.words(data)
    return hasher.spans(sums, starts, ends)


def shingle_hashes(hasher: SpanHasher, data: bytes, n: int) -> np.ndarray:
    """One hash per run of *n* words; a text of fewer words, but not none, is one run."""
    if not data:
        return np.empty(0, np.uint64)
    sums, starts, ends = hasher.words(data)
    if len(starts) < n:
        return hasher.spans(sums, starts[:1], ends[-1:])
    return hasher.spans(sums, starts[: len(starts) - n + 1], ends[n - 1:])
