"""Hashed character n-grams of whole texts, for the two linear classifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with a blank at both ends; runs of anything but letters are one blank."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = raw > 127
    letter |= (raw >= 97) & (raw <= 122)
    keep = np.empty(len(raw) + 2, bool)
    out = np.full(len(raw) + 2, 32, np.uint32)
    out[1:-1][letter] = raw[letter]
    keep[0] = True
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32)
    return out[keep]


def grams(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """For each size, the bucket of every n-gram of the text; none for texts that are too short."""
    state = points * _MIX[0]
    state ^= state >> np.uint32(15)
    rolled, have = state.copy(), 1
    for n in sizes:
        while have < n and len(rolled) > 1:
            rolled = (rolled[:-1] * _MIX[1]) ^ state[have:]
            rolled ^= rolled >> np.uint32(13)
            have += 1
        if have == n:
            yield (rolled * _MIX[2]) >> np.uint32(32 - bits)
        elif len(rolled) <= 1:
            return
