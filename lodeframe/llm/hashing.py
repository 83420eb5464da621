"""64-bit hashes of words and of fixed-length byte strings, for whole texts at once.

A string's hash is the sum of its bytes' random values times the powers of an odd base, which running sums give
for any string inside a text; the power of its place is then taken out, so it depends on the string alone.
"""

from __future__ import annotations

import numpy as np

from .common import mix

SEGMENT = 1 << 20
_RANDOM = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    if not _powers or len(_powers[0][0]) < n:
        size, made = max(n, 1 << 16), []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers[:] = [tuple(made)]
    return _powers[0]


def sums(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums, from 0, and the inverse powers."""
    power, inverse = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_RANDOM[b] * power[: len(b)], out=total[1:])
    return total, inverse


def word_hashes(raw: bytes) -> np.ndarray:
    """The words [^ \\t-\\r]+ of a text, in order. Long texts are taken in segments that end at blanks."""
    if len(raw) <= SEGMENT:
        return _words(raw)
    out, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + SEGMENT)
        while stop < len(raw) and raw[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        out.append(_words(raw[at:stop]))
        at = stop
    return np.concatenate(out)


def _words(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    blank = np.ones(len(b) + 2, dtype=np.int8)
    blank[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
    edge = np.diff(blank)
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    total, inverse = sums(b)
    return mix((total[stop] - total[start]) * inverse[start] + (stop - start).astype(np.uint64))


def chain(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * np.uint64(0x100000001B3) + words[i : i + n])
    return out


def substrings(b: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` consecutive bytes."""
    if len(b) < size:
        return np.zeros(0, dtype=np.uint64)
    total, inverse = sums(b)
    n = len(b) - size + 1
    return mix((total[size:] - total[:n]) * inverse[:n])
