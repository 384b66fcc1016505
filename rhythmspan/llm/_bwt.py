"""Common prefixes by threshold-bounded interval expansion on a Burrows-Wheeler transform (numpy)."""

from __future__ import annotations

import numpy as np


def rotation_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The rotations of a byte text in order of their first ``depth`` bytes at least (doubling)."""
    n = len(text)
    key, done = text.astype(np.uint64), 1
    while done < 8:
        key = (key << np.uint64(8 * done)) | np.roll(key, -done)
        done *= 2
    while True:
        order = np.argsort(key, kind="stable" if n < 64 else None)
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        if done >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * n + np.roll(rank, -done)
        done *= 2


def bounded_prefix_runs(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, run): rotations in order, and for each the number of the run that shares ``least`` bytes.

    Breadth-first backward extension: the interval of a string w gives the intervals of all c + w.
    All strings of length l + 1 are reached after those of length l, so a boundary that is met for
    the first time from length l has a common prefix of exactly l. An interval whose right
    boundary is known is not followed. Expansion stops at ``least``: boundaries unmet by then have
    common prefixes of at least that length.
    """
    n = len(text)
    order = rotation_order(text, least)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    to = np.empty(n, np.int64)  # from a row to the row of the rotation that starts one byte earlier
    to[by_symbol] = np.arange(n)
    same = bwt[by_symbol][1:] == bwt[by_symbol][:-1]
    before, after = np.full(n, -1), np.full(n, n)  # the nearest rows with the same byte
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    met = np.zeros(n + 1, bool)
    met[[0, n]] = True
    left, right = np.zeros(1, np.int64), np.full(1, n)
    for _ in range(least):
        size = right - left
        one = left[size == 1]
        left, right, size = left[size > 1], right[size > 1], size[size > 1]
        ends = np.cumsum(size)
        rows = np.arange(ends[-1] if len(ends) else 0) + np.repeat(left - (ends - size), size)
        first, last = rows[before[rows] < np.repeat(left, size)], rows[after[rows] >= np.repeat(right, size)]
        # intervals of one length are disjoint, so sorted starts and sorted ends belong together
        left, right = np.sort(np.r_[to[one], to[first]]), np.sort(np.r_[to[one], to[last]]) + 1
        new = ~met[right]
        left, right = left[new], right[new]
        met[right] = True
        if not len(left):
            break
    return order, np.cumsum(met[:n]) - 1


def repeated_starts(parts: list[bytes], places: np.ndarray, least: int) -> np.ndarray:
    """Flags over the joined parts: does the ``least``-byte string that starts here (and ends within
    its part) also start at another place? ``places`` numbers the joined bytes by where they stand
    in the corpus; two bytes of one number are one place."""
    text = np.frombuffer(b"".join(parts), np.uint8)
    out = np.zeros(len(text), bool)
    if len(text) < 2:
        return out
    sizes = np.array([len(p) for p in parts])
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    order, run = bounded_prefix_runs(text, least)
    inside = room[order] >= least
    order, run = order[inside], run[inside]
    if len(order):
        heads = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        place = places[order]
        many = np.minimum.reduceat(place, heads) != np.maximum.reduceat(place, heads)
        out[order[np.repeat(many, np.diff(np.r_[heads, len(order)]))]] = True
    return out
