"""64-bit hashes of words and of runs of words, for whole slices of text at once."""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial, constants of the finishing mix.
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(31))


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    """base ** 0 .. n - 1; the longest one so far is kept."""
    kept = _powers.get(name)
    if kept is None or len(kept) < n:
        with np.errstate(over="ignore"):
            kept = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 1 << 16) - 1, base)])
        if len(kept) <= 4_000_000:
            _powers[name] = kept
    return kept[:n]


class Words:
    """Words of one byte string: maximal runs of bytes whose ``table`` entry is not 0; other entries replace the bytes."""

    def __init__(self, raw: bytes, table: np.ndarray):
        self.bytes = table[np.frombuffer(raw, np.uint8)]
        inside = np.zeros(len(self.bytes) + 2, np.int8)
        inside[1:-1] = self.bytes != 0
        edge = np.flatnonzero(np.diff(inside))
        self.start, self.end = edge[::2], edge[1::2]
        n = len(self.bytes)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE[self.bytes] * _power(BASE, n, "up"), out=self._sum[1:])

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None, salt: int = 0) -> np.ndarray:
        """Hash of the bytes from start to end, by default of every word, and of their number."""
        start, end = (self.start, self.end) if start is None else (start, end)
        low = _power(_INVERSE, len(self.bytes) + 1, "down")[start]
        return mix((self._sum[end] - self._sum[start]) * low + (end - start).astype(np.uint64) * MIX[1] + np.uint64(salt))

    def firsts(self, offsets: np.ndarray) -> np.ndarray:
        """For texts that begin at byte ``offsets``: index of the first word at or behind each."""
        return np.searchsorted(self.start, offsets)


def joined(texts: list[bytes], gap: bytes) -> tuple[bytes, np.ndarray]:
    """Texts with a gap behind each, and where each begins, with the end."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(gap)
    return b"".join(x + gap for x in texts), np.r_[0, np.cumsum(sizes)]


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words."""
    out = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        out = out * BASE + words[k : len(words) - width + 1 + k]
    return mix(out)
