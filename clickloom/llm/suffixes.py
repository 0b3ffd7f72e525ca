"""Two-stage suffix sorting of short text pieces.

The suffixes that are smaller than their successors are sorted directly. All
others follow from them: scanning the buckets of the first byte in order, each
suffix met puts the one that starts a byte earlier, if that one is larger, at
the next place of its bucket. Order counts up to a fixed depth.
"""

from __future__ import annotations

import numpy as np

_KEEP = np.array([0] + [(0xFFFFFFFFFFFFFFFF << (8 * (8 - k))) & 0xFFFFFFFFFFFFFFFF for k in range(1, 9)], np.uint64)


def _words(text: np.ndarray) -> np.ndarray:
    """At each position the next 8 bytes as a big-endian number (text padded with 8 zeros)."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    grid = np.lib.stride_tricks.as_strided(padded, (len(text) + 1, 8), (1, 1))
    return np.ascontiguousarray(grid).view(">u8").reshape(-1).astype(np.uint64)


def _load(grid: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """8 bytes from each position, those beyond what is left as zeros."""
    return grid[np.minimum(at, len(grid) - 1)] & _KEEP[np.clip(left, 0, 8)]


def _smaller_than_next(text: np.ndarray, ends: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than its successor within its piece."""
    n = len(text)
    change = np.append(text[1:] != text[:-1], True)
    change[ends[ends > 0] - 1] = True
    change = np.flatnonzero(change)
    follow = np.repeat(change, np.diff(change, prepend=-1)) + 1  # where the run of equal bytes ends
    inside = follow < ends[piece]
    return inside & (text[np.minimum(follow, n - 1)] > text)


def _direct(grid: np.ndarray, at: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """The order of the given suffixes by up to ``depth`` bytes; equal ones in any order.

    Each round orders those not yet alone by their group and the next few bytes,
    both in one number.
    """
    n = len(at)
    width = (64 - n.bit_length()) // 8  # bytes beside a group's number
    order, group = np.arange(n), np.zeros(n, np.uint64)
    open_ = np.arange(n)  # places whose suffix is not yet alone in its group
    for k in range(0, depth, width):
        if not len(open_):
            break
        here = order[open_]
        left = np.minimum(ends[here] - at[here] - k, min(depth - k, width))
        key = group[open_] << np.uint64(8 * width) | _load(grid, at[here] + k, left) >> np.uint64(64 - 8 * width)
        by = np.argsort(key)
        order[open_] = here[by]
        key = key[by]
        new = np.append(True, key[1:] != key[:-1])
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
    return order


def sort_windows(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All starts of ``depth`` bytes within the pieces, in the order of these bytes.

    ``text`` holds pieces [starts, ends) one after the other. Returns the sorted
    positions and, for each, whether it shares ``depth`` bytes with the one
    before it.
    """
    n = len(text)
    none = np.zeros(0, np.int64), np.zeros(0, bool)
    if not n or not (ends - starts >= depth).any():
        return none
    piece = np.repeat(np.arange(len(starts)), ends - starts)
    grid = _words(text)
    small = _smaller_than_next(text, ends, piece)
    where = np.arange(n)
    last = ends[piece] - depth  # of the starts asked for
    asked = where <= last
    # A larger suffix follows from its successor, so the run of larger ones behind the last start belongs to the set.
    stop = small.copy()
    stop[ends[ends > 0] - 1] = True
    stop = np.flatnonzero(stop)
    reach = np.repeat(stop, np.diff(stop, prepend=-1))[np.maximum(last, 0)]
    member = asked | ((where <= reach) & (last >= starts[piece]))
    larger = member & ~small

    seeds = np.flatnonzero(member & small)
    seeds = seeds[_direct(grid, seeds, ends[piece[seeds]], depth)]
    first = text[seeds]
    seed_at = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray) -> None:
        """Put the larger predecessors of the suffixes into their buckets."""
        before = found - 1
        before = before[(before >= 0)]
        before = before[larger[before] & (before + 1 < ends[piece[before]])]
        if len(before):
            by = np.argsort(text[before], kind="stable")
            before = before[by]
            head = text[before]
            edges = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(before))):
                waiting[head[a]].append(before[a:b])

    # The empty suffix behind each piece comes before all others.
    tails = ends - 1
    tails = tails[(tails >= 0) & (ends > starts)]
    tails = tails[larger[tails]]
    by = np.argsort(text[tails], kind="stable")
    for c, part in _by_byte(text, tails[by]):
        waiting[c].append(part)
    out = []
    for c in range(256):
        while waiting[c]:
            found, waiting[c] = np.concatenate(waiting[c]), []
            out.append(found)
            induce(found)
        found = seeds[seed_at[c] : seed_at[c + 1]]
        if len(found):
            out.append(found)
            induce(found)
    order = np.concatenate(out)
    order = order[asked[order]]
    return order, _shared(grid, order, depth)


def _by_byte(text: np.ndarray, at: np.ndarray):
    head = text[at]
    edges = np.flatnonzero(np.append(True, head[1:] != head[:-1])) if len(at) else []
    for a, b in zip(edges, np.append(edges[1:], len(at)) if len(at) else []):
        yield int(head[a]), at[a:b]


def _shared(grid: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix has a common prefix of ``depth`` bytes with its predecessor in the order."""
    same = np.ones(len(order), bool)
    if len(order):
        same[0] = False
    for k in range(0, depth, 8):
        todo = np.flatnonzero(same)
        left = np.full(len(todo), depth - k)
        same[todo] = _load(grid, order[todo] + k, left) == _load(grid, order[todo - 1] + k, left)
    return same
