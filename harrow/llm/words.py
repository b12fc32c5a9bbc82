"""64-bit hashes of words, for whole columns of texts at once and without a store of words."""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18  # bytes that are hashed at once; a longer word is one piece
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.isin(np.arange(256), [*range(9, 14), 32])
# A value for each byte; those of A-Z are those of a-z.
_VALUES = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64, endpoint=False)
_VALUES[65:91] = _VALUES[97:123]


def powers(n: int) -> list[np.ndarray]:
    """At least the first ``n`` powers of an odd base, and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, base, np.uint64), dtype=np.uint64)])
    return _POWERS


def spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a piece."""
    space = np.concatenate([[True], _SPACE[data], [True]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, stops = edges[::2], edges[1::2]
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUES[data] * up[: len(data)], dtype=np.uint64)])
    return starts, spread((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def hashes(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the hashes of its words: runs of anything but ASCII white space, A-Z lower-cased. Null has none."""
    bodies = [(t or "").encode() for t in texts]
    ends = np.cumsum([len(b) + 1 for b in bodies])
    data = np.frombuffer(b"\n".join(bodies) + b"\n", np.uint8)
    starts, found, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data) and not _SPACE[data[stop - 1]]:  # up to the next white space
            gap = np.flatnonzero(_SPACE[data[stop : stop + PIECE]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(len(data), stop + PIECE)
        s, h = _hashed(data[at:stop])
        starts.append(s + at)
        found.append(h)
        at = stop
    counts = np.searchsorted(np.concatenate(starts), ends) if texts else []
    return np.split(np.concatenate(found), counts)[: len(texts)] if texts else []
