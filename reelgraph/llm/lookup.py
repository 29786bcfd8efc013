"""Hash tables over 64-bit codes for numpy: many codes are looked up at once."""

from __future__ import annotations

import numpy as np

_MIX, _FREE = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)


class Lookup:
    """Values by code (any but 2**64 - 1): open addressing with linear probing, at most half full."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        size = 1 << max(4, int(2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - (size.bit_length() - 1)), np.int64(size - 1)
        self.codes, self.values = np.full(size, _FREE, np.uint64), np.zeros(size, values.dtype)
        left, at = np.arange(len(codes)), self._home(codes)
        while len(left):
            wants = left[self.codes[at[left]] == _FREE]
            first = wants[np.unique(at[wants], return_index=True)[1]]  # of those that want a free slot one gets it
            self.codes[at[first]], self.values[at[first]] = codes[first], values[first]
            left = left[self.codes[at[left]] != codes[left]]
            at[left] = (at[left] + 1) & self.mask

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _MIX) >> self.shift).astype(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether each code is known); what stands for an unknown code means nothing."""
        at = self._home(codes)
        seen, values = self.codes[at], self.values[at]
        hit = seen == codes
        left = np.flatnonzero(~hit & (seen != _FREE))
        while len(left):
            slot = (at[left] + 1) & self.mask
            at[left], seen = slot, self.codes[slot]
            good = seen == codes[left]
            hit[left[good]], values[left[good]] = True, self.values[slot[good]]
            left = left[~good & (seen != _FREE)]
        return values, hit
