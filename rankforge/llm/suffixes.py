"""Suffix sorting of coded words by prefix doubling."""

from __future__ import annotations

import numpy as np


def suffix_ranks(first: np.ndarray, after: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until every rank is unique.

    ``first`` is the key of each suffix's first word; ``after`` is the number of words that follow it in its text. No two
    suffixes may be equal up to their texts' ends: either texts share no key or each ends with a key of its own.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    level = np.zeros(n, np.int64)
    new = np.concatenate([[True], first[order][1:] != first[order][:-1]])
    start = np.flatnonzero(new)
    level[order] = np.repeat(start, np.diff(np.append(start, n)))
    levels, step = [level.astype(np.int32)], 1
    active = order[np.repeat(np.diff(np.append(start, n)) > 1, np.diff(np.append(start, n)))]
    while len(active):
        rank = levels[-1]
        follows = np.where(after[active] >= step, rank[np.minimum(active + step, n - 1)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + follows
        by = np.argsort(key, kind="stable")
        key, active = key[by], active[by]
        group = rank[active]
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        first_of_group = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(active))
        in_group = place - np.maximum.accumulate(np.where(first_of_group, place, 0))
        offset = np.where(begins, in_group, 0)
        run = np.flatnonzero(begins)
        length = np.diff(np.append(run, len(active)))
        rank = rank.copy()
        rank[active] = group + np.repeat(offset[run], length)
        levels.append(rank)
        active, step = active[np.repeat(length > 1, length)], step * 2
    return levels
