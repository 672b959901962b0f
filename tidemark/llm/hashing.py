"""Vectorised polynomial hashes of words, word windows and byte ranges (modulo 2**64)."""

from __future__ import annotations

from functools import cache

import numpy as np

#: An odd multiplier has an inverse modulo 2**64, so a prefix hash gives the hash of any range.
BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 20
#: The six ASCII space characters that part words, 0x20 and 0x09 to 0x0D.
SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def byte_table(fold: bool = False, seed: int = 1) -> np.ndarray:
    """A 64-bit value for each byte; with ``fold``, A-Z share the values of a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1))
    if fold:
        table[65:91] = table[97:123]
    return table


@cache
def space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


_powers: dict[str, np.ndarray] = {}
#: Powers up to this number are kept by a worker; more are made for one call.
KEPT = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` for i below ``n`` or more."""
    if len(_powers.get("up", ())) >= n:
        return _powers["up"], _powers["down"]
    made = []
    for step in (BASE, pow(BASE, -1, 1 << 64)):
        out = np.full(max(n, KEPT), step, np.uint64)
        out[0] = 1
        made.append(np.multiply.accumulate(out, out=out))
    if n <= KEPT:
        _powers["up"], _powers["down"] = made
    return made[0], made[1]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """``n + 1`` prefix sums of ``values[i] * BASE**i``."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges, equal for equal contents wherever they stand."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than the six space characters."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = space_table()[data]
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    return turns[::2], turns[1::2]


def word_hashes(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order. Long texts go block by block, cut between words."""
    table = byte_table(fold)
    if len(data) <= BLOCK:
        return _word_hashes(data, table)
    spaces, parts, at = space_table(), [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        while end < len(data) and not spaces[data[end]]:
            end += 1
        parts.append(_word_hashes(data[at:end], table))
        at = end
    return np.concatenate(parts)


def _word_hashes(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    start, end = word_bounds(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    return mix(range_hashes(prefix_hashes(table[data]), start, end) + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``len(words) - k + 1`` runs of ``k`` words, in order; empty where there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(BASE) + words[i : i + n])
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct ``k``-word windows, sorted by hash; a shorter text is one shingle, an empty one has none."""
    if not len(words):
        return words
    return np.unique(windows(words, min(k, len(words))))
