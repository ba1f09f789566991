"""Word and word-sequence hashes of texts, without a Python object per word.

Words are runs without ASCII white space. Most arithmetic is modulo 2^64; bytes pass through a table
of random numbers first, and sums are mixed, so values behave like random 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORD_SEED = 20240229
# bytes.split() parts at ASCII white space only: 9 to 13 and 32
_PLAIN = bytes(range(256)).lower()
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_BYTES = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up[:n], cls.down[:n]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words."""
    inside = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(text: str | None, lower: bool) -> np.ndarray:
    """One 64-bit hash per word, in order; `lower` makes A-Z equal to a-z."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    starts, ends = word_spans(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _BYTES)[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of `width` words, in order; none for shorter texts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _Powers.upto(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[:n] * _STEP)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` lower-cased words; a shorter text is one run.

    Here equal hashes count as equal runs, so words go through XXH3 and are mixed in one after the
    other: sums of powers, as above, have words of their own making that collide.
    """
    words = lower_ascii((text or "").encode()).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = {word: xxhash.xxh3_64_intdigest(word, seed=WORD_SEED) for word in set(words)}
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    runs = np.full(len(words) - width + 1, width, np.uint64)
    for n in range(width):
        runs = mixed(runs * _STEP + hashes[n : n + len(runs)])
    return np.unique(runs)


def lower_ascii(data: bytes) -> bytes:
    """A-Z as a-z; all other bytes stay."""
    return data.translate(_PLAIN)
