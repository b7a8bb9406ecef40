"""Suffix order and longest previous factors of byte arrays, up to a limit of length."""

from __future__ import annotations

import numpy as np


def _dense(key: np.ndarray) -> np.ndarray:
    order = np.argsort(key, kind="stable")
    ranks = np.empty(len(key), np.int64)
    ordered = key[order]
    ranks[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
    return ranks


def rank_levels(data: np.ndarray, limit: int) -> dict[int, np.ndarray]:
    """For 8, 16, 32 ... and limit: each place's rank among all by so many bytes from there on; beyond the end stand zeros."""
    if limit < 8:
        raise ValueError("the limit is 8 bytes at least")
    count = len(data)
    padded = np.concatenate([data, np.zeros(limit + 8, np.uint8)])
    words = np.ndarray((count,), ">u8", padded.tobytes(), 0, (1,)).astype(np.uint64)
    levels, size = {8: _dense(words)}, 8
    while size < limit:
        step = min(size, limit - size)
        last = levels[size]
        ahead = np.zeros(count, np.int64)  # rank 0 where nothing follows
        ahead[: max(count - step, 0)] = last[step:] + 1
        levels[size + step] = _dense(last * (int(ahead.max(initial=0)) + 1) + ahead)
        size += step
    return levels


def common_prefix(levels: dict[int, np.ndarray], data: np.ndarray, one: np.ndarray, two: np.ndarray, limit: int) -> np.ndarray:
    """Length of the bytes that the suffixes at one and two share, up to limit."""
    count = len(data)
    same = np.zeros(len(one), np.int64)
    whole = levels[limit][one] == levels[limit][two]
    for size in sorted((s for s in levels if s < limit), reverse=True):
        a, b = one + same, two + same
        inside = (a + size <= count) & (b + size <= count)
        equal = inside & (levels[size][np.minimum(a, count - 1)] == levels[size][np.minimum(b, count - 1)])
        same += np.where(equal & (same + size <= limit), size, 0)
    for _ in range(8):
        a, b = one + same, two + same
        inside = (a < count) & (b < count) & (same < limit)
        same += inside & (data[np.minimum(a, count - 1)] == data[np.minimum(b, count - 1)])
    return np.where(whole & (np.maximum(one, two) + limit <= count), limit, same)


def _smaller(places: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest earlier entry that is smaller, or -1: pointers jump over what is known to be larger."""
    found = np.arange(-1, len(places) - 1)
    while True:
        bad = np.flatnonzero((found >= 0) & (places[np.maximum(found, 0)] > places))
        if not len(bad):
            return found
        found[bad] = found[found[bad]]


def longest_previous_factor(data: np.ndarray, starts: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending starts: how many bytes from there on also begin at an earlier one of them, and at which (-1: none).

    In suffix order the earlier suffix that shares most stands at the previous or the next smaller position; what two suffixes
    share is the least of what neighbours between them share. Lengths over limit count as limit.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = rank_levels(data, limit)
    order = np.lexsort((starts, levels[limit][starts]))
    suffix = starts[order]
    length, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1, np.int64)
    backward = len(starts) - 1 - _smaller(suffix[::-1])[::-1]
    for other in (_smaller(suffix), np.where(backward == len(starts), -1, backward)):
        has = np.flatnonzero(other >= 0)
        shared = common_prefix(levels, data, suffix[has], suffix[other[has]], limit)
        better = shared > length[order[has]]
        length[order[has][better]] = shared[better]
        source[order[has][better]] = suffix[other[has][better]]
    return length, source
