"""Word shingles, set digests and minwise signatures, as NumPy kernels over one text at a time.

Words are maximal runs of bytes other than space and 0x09-0x0D, after lower-casing A-Z. A text with
fewer than k words has one shingle, the whole sequence; a null text or one without words has none.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_rng = np.random.default_rng(20240229)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
FUNCTIONS = 64
_MULT = _rng.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * _U(2) + _U(1)
_ADD = _rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the odd base (up) or of its inverse modulo 2^64 (down), at least n of them."""
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers[kind] = np.cumprod(np.concatenate([[_U(1)], np.full(max(n, 1 << 16), _U(base))]), dtype=np.uint64)
    return _powers[kind]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
        return h ^ (h >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of the text, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([[_U(0)], np.cumsum((raw.astype(np.uint64) + _U(1)) * _power("up", len(raw))[: len(raw)], dtype=np.uint64)])
        return mix((prefix[end] - prefix[start]) * _power("down", len(raw))[start])


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles."""
    words = word_hashes(text)
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            return mix(np.array([(words * _STEP[:n]).sum(dtype=np.uint64) + _U(n * 0xD6E8FEB86659FD93 & _MASK)], np.uint64))
        h = words[: n - k + 1] * _STEP[0]
        for j in range(1, k):
            h = h + words[j : n - k + 1 + j] * _STEP[j]
    return np.unique(mix(h))


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit sums that identify a set together with its size."""
    with np.errstate(over="ignore"):
        a, b = s.sum(dtype=np.uint64), mix(s ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of 64 hash functions over a set that isn't empty, as uint32."""
    low = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(s), 4096):
            low = np.minimum(low, (s[i : i + 4096, None] * _MULT + _ADD).min(axis=0))
    return (low >> _U(32)).astype(np.uint32)


def bits(sig: np.ndarray) -> tuple[int, int]:
    """128 bits of a signature, two for each function: equal minima give equal bits, other minima any."""
    h = mix(sig.astype(np.uint64) + np.arange(FUNCTIONS, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
    two = np.packbits(np.stack([h & _U(1), (h >> _U(1)) & _U(1)]).astype(np.uint8)).view(">i8")
    return int(two[0]), int(two[1])
