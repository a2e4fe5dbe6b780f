"""Blocked Bloom filters over 64-bit hashes: all bits of an entry lie in one 64-bit block."""

from __future__ import annotations

import numpy as np

_BITS = 5


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each number."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def block_and_mask(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of a filter that a hash falls into and the bits it sets there."""
    x = mixed(h)
    mask = np.zeros(h.shape, np.uint64)
    for k in range(_BITS):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), mask


def may_hold(filter_blocks: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in a filter; never false for one that is."""
    at, mask = block_and_mask(h, len(filter_blocks))
    return (filter_blocks[at.astype(np.int64)] & mask) == mask
