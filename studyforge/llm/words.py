"""Word boundaries and 64-bit word hashes of a batch of texts, as array operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x)]), dtype=np.uint64) for x in (BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Words:
    """Words of a batch: number of their text, hash, first and past-the-end byte, and all bytes."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray


def words_of(texts: list[str], lower: bool = True) -> Words:
    """Maximal runs without the six white-space bytes; lower folds A-Z only."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    lens = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    doc = np.searchsorted(np.cumsum(lens), start, "right")
    power, inverse = _power(len(data))
    value = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    value *= power
    total = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    # the length keeps apart what the polynomial alone might not
    h = (total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)
    return Words(doc, mix64(h), start, end, data)
