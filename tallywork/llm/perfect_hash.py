"""A minimal perfect hash in level bit arrays: each level keeps the keys that land alone, the others go on."""

from __future__ import annotations

import numpy as np

GAMMA, LEVELS = 1.5, 40
_MULTIPLY = np.array([0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)  # fixed values: a 64-bit finaliser


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    x = keys + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for m in _MULTIPLY:
        x = (x ^ (x >> np.uint64(33))) * m
    return x ^ (x >> np.uint64(33))


def build(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Level bit arrays for uint64 keys, and the places of keys that no level could separate (equal keys, mostly)."""
    levels, left = [], np.arange(len(keys))
    while len(left) and len(levels) < LEVELS:
        size = max(64, int(GAMMA * len(left)))
        at = (mixed(keys[left], len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        levels.append(bits)
        left = left[~alone]
    return levels, left


def places(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The number from 0 of each key, -1 for one that no level holds. A key outside the set may get any number."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for salt, bits in enumerate(levels):
        at = (mixed(keys[left], salt) % np.uint64(len(bits))).astype(np.int64)
        rank = np.cumsum(bits)
        hit = bits[at]
        out[left[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1]) if len(rank) else 0
        left = left[~hit]
    return out
