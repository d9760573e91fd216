"""Deep-shallow sorting of fixed-length substrings, in numpy.

Multikey quicksort orders the suffixes by 8-byte characters up to a shallow depth. Groups that
still agree there have a long common prefix; each is ordered by a blind trie, which keeps only
the depths at which its members part and skips what they share. All tries of a call are built
together, level by level.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 32
STEP = 8


def _characters(text: bytes, length: int) -> np.ndarray:
    """The 8 bytes from each position on, as one number that sorts like them."""
    padded = text + b"\0" * (length + STEP)
    return np.ndarray(shape=(len(padded) - STEP + 1,), dtype=">u8", buffer=padded, strides=(1,))


def _regrouped(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (group, key), and for its places whether a new pair begins there."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, new


def sort_substrings(text: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): the substrings of ``length`` bytes at ``starts`` in order, and a number for each place that equal ones share.

    ``length`` is a multiple of 8 and larger than SHALLOW.
    """
    chars = _characters(text, length)
    rank = np.zeros(len(starts), np.int64)  # rank of a group: the place of its first member
    active = np.arange(len(starts))

    def split(members: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
        """Ranks ``members`` anew by the character at ``depth``; those in groups of two or more come back."""
        key = chars[starts[members] + depth].astype(np.uint64)
        order, new = _regrouped(rank[members], key)
        members = members[order]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(members)))
        # a member's rank grows by its group's place within the group it was part of
        old = rank[members]
        opened = np.ones(len(members), bool)
        opened[1:] = old[1:] != old[:-1]
        begin = np.maximum.accumulate(np.where(opened, np.arange(len(members)), 0))
        rank[members] = old + np.repeat(first, sizes) - begin
        return members[np.repeat(sizes > 1, sizes)]

    for depth in range(0, SHALLOW, STEP):
        if not len(active):
            break
        active = split(active, depth)

    depth = np.full(len(starts), SHALLOW)
    while len(active):
        # the depth at which each group's blind trie branches: least common prefix with its first member
        active = active[np.argsort(rank[active], kind="stable")]
        r = rank[active]
        new = np.ones(len(active), bool)
        new[1:] = r[1:] != r[:-1]
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(active)))
        leader = np.repeat(active[first], sizes)
        common = depth[active].copy()
        same = np.arange(len(active))
        while len(same):
            same = same[common[same] < length]
            same = same[chars[starts[active[same]] + common[same]] == chars[starts[leader[same]] + common[same]]]
            common[same] += STEP
        branch = np.repeat(np.minimum.reduceat(common, first), sizes)
        depth[active] = branch
        parting = branch < length
        active = active[parting]
        if len(active):
            active = split(active, depth[active])
            depth[active] += STEP
    order = np.argsort(rank, kind="stable")
    return order, rank[order]
