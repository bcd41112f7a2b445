"""Hashes of byte windows, on NumPy arrays: the content-defined cuts and anchors of several operators."""

from __future__ import annotations

import numpy as np

_MULT = 0x9E3779B97F4A7C15
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads the high quality of a product's upper bits over all 64."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def windows(data: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of each window of ``k`` (a power of two) bytes, by doubling: k = 32 takes five passes."""
    h = data.astype(_U) + _U(1)
    span = 1
    while span < k:
        if len(h) <= span:
            return h[:0]
        h = h[:-span] * _U(pow(_MULT, span, 1 << 64)) + h[span:]
        span *= 2
    return mix(h)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours."""
    if len(h) < w:
        return h[:0]
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = w - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h
