"""Word shingles of texts as sorted arrays of 64-bit hashes, computed over bytes for many texts at once."""

from __future__ import annotations

import numpy as np

from tidelog.llm.common import mix64

FACTOR = 0xD1342543DE82EF95
INVERSE = pow(FACTOR, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: What a byte counts in a word's hash: 0 for white space, A-Z as a-z.
VALUES = np.arange(1, 257, dtype=np.uint64)
VALUES[65:91] = VALUES[97:123]
VALUES[[9, 10, 11, 12, 13, 32]] = 0


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((FACTOR, INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[i] = np.cumprod(row)
    return _POWERS


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, in order, and where each text's words start, with the end."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    values = VALUES[data]
    solid = values > 0
    starts = np.empty(len(data), bool)
    starts[0] = solid[0]
    np.logical_and(solid[1:], ~solid[:-1], out=starts[1:])
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    up, down = _powers(len(data))
    return mix64(np.add.reduceat(values * up[: len(data)], at) * down[at]), np.searchsorted(at, begins)


def shingle_sets(texts: list[bytes], words: int = 3) -> list[np.ndarray]:
    """Each text's distinct shingles of ``words`` words, sorted; with fewer words the whole sequence is
    one shingle, without any the set is empty."""
    hashes, begins = word_hashes(texts)
    mixed = np.zeros(len(hashes), np.uint64)
    for k in range(words):
        mixed[: len(hashes) - k] += hashes[k:] * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    mixed = mix64(mixed)
    out = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(mixed[a : b - words + 1]))
        elif b > a:
            short = sum(int(h) * pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k, h in enumerate(hashes[a:b].tolist())) + (b - a) * 0xA0761D6478BD642F
            out.append(mix64(np.array([short & 0xFFFFFFFFFFFFFFFF], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
