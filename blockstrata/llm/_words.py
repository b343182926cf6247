"""Vectorised words, lines, characters and hashes over many UTF-8 texts at once.

All hashes come from one prefix sum per chunk of texts: ``prefix[i]`` is the sum of
``code(byte j) * base**j`` over ``j < i`` modulo 2**64, so any span's hash costs one
subtraction and one multiplication by a power of the base's inverse.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Powers up to this are kept, 8 bytes each.
_KEPT_POWERS = (1 << 19) + 1024
_POWERS = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS[kind]
    if len(have) < n:
        steps = np.full(max(n, _KEPT_POWERS), _BASE if kind == "base" else _INVERSE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= _KEPT_POWERS:  # longer ones are made when they are needed
            _POWERS[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


#: Of symbols 0 to 256: a byte plus one, or 0.
SYMBOL_CODES = np.concatenate([[np.uint64(0xA24BAED4963EE407)], _CODES])


def prefix_hashes(raw: np.ndarray, codes: np.ndarray = _CODES) -> np.ndarray:
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes[raw] * _powers("base", len(raw)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * _powers("inverse", len(prefix))[starts])


def run_hashes(prefix: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all spans of ``length`` bytes, as span_hashes has them."""
    h = prefix[length:] - prefix[:-length]
    h *= _powers("inverse", len(prefix))[: len(h)]
    shifted = h >> U64(32)
    for _ in range(2):
        h ^= shifted
        h *= U64(0xD6E8FEB86659FD93)
        np.right_shift(h, U64(32), out=shifted)
    h ^= shifted
    return h


class Texts:
    """A chunk of texts: ``raw`` bytes, ``offs`` offsets of each text in them."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = False) -> None:
        self.raw, self.offs, n = raw, offs, len(raw)
        self.prefix = prefix_hashes(raw, _LOWER if lower else _CODES)
        space = _SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        solid = ~space
        before = np.ones(n, bool)
        before[1:] = space[:-1]
        after = np.ones(n, bool)
        after[:-1] = space[1:]
        self.solid = solid
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        #: words of text i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, offs)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte spans."""
        return span_hashes(self.prefix, starts, ends)

    def words(self) -> np.ndarray:
        return self.spans(self.starts, self.ends)

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        total = np.zeros(len(self.raw) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words; the caller leaves out runs that cross texts."""
    n = max(0, len(words) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out += words[k : k + n] * U64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) | 1)
    return mix(out)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, a place of each, which of them each key is); faster than a stable sort gives the first places."""
    order = np.argsort(keys)
    at = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = at[1:] != at[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return at[new], order[new], which
