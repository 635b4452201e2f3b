"""Suffix arrays of many short strings at once, by linear grouping.

The construction has two phases and no recursion. Phase one keeps the suffixes
of a string in groups that lie in lexicographic order and share a prefix; it
starts from the first symbols and takes the groups from the last to the first.
For each suffix of the group taken it finds the nearest suffix to the left that
is in a lower group (its previous smaller suffix, found along the pointers
already set). Those suffixes leave their group for new ones right behind it,
ordered by how many suffixes of the taken group point at them. In the end a
group holds the suffixes with the same Lyndon prefix. Phase two reads the order
from the front: the suffix before one that has its place, and then the suffixes
along its pointers, take the next free place of their groups.

All strings of a batch advance together: step k takes the k-th last group of
every string, and each step is a handful of numpy operations on flat arrays.
"""

from __future__ import annotations

import numpy as np


def suffix_arrays(text: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Flat suffix arrays of the strings ``text[base[k]:base[k + 1]]``.

    Each string ends with a symbol smaller than all its others. Positions are
    positions of ``text``.
    """
    n = len(text)
    sizes = np.diff(base)
    lane = np.repeat(np.arange(len(sizes)), sizes)
    sa = np.lexsort((text, lane))
    isa = np.empty(n, np.int64)
    isa[sa] = np.arange(n)
    sorted_symbol, sorted_lane = text[sa], lane[sa]
    fresh = np.concatenate(([True], (sorted_symbol[1:] != sorted_symbol[:-1]) | (sorted_lane[1:] != sorted_lane[:-1])))
    start = np.flatnonzero(fresh)
    group = np.empty(n, np.int64)
    group[sa] = np.repeat(start, np.diff(np.append(start, n)))
    size = np.zeros(n + 1, np.int64)
    size[start] = np.diff(np.append(start, n))
    previous = np.full(n, -1, np.int64)
    chosen = np.zeros(n, bool)

    first_of = base[:-1]
    busy = np.flatnonzero(sizes > 0)
    taken = group[sa[base[1:][busy] - 1]]
    while len(busy):
        members_each = size[taken]
        ends = np.cumsum(members_each)
        slot = np.arange(ends[-1]) + np.repeat(taken - (ends - members_each), members_each)
        member = sa[slot]
        mine, left_end = np.repeat(taken, members_each), np.repeat(first_of[busy], members_each)
        near = np.where(member > left_end, member - 1, -1)
        previous[member] = near
        open_ = np.flatnonzero(near >= 0)
        open_ = open_[group[near[open_]] >= mine[open_]]
        while len(open_):
            step = previous[near[open_]]
            near[open_] = step
            previous[member[open_]] = step
            open_ = open_[step >= 0]
            open_ = open_[group[near[open_]] >= mine[open_]]
        target = np.sort(near[near >= 0])
        if len(target):
            at = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
            pointed, count = target[at], np.diff(np.append(at, len(target)))
            order = np.lexsort((count, group[pointed]))
            pointed, count = pointed[order], count[order]
            old = group[pointed]
            lead = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            leaving = np.diff(np.append(lead, len(old)))
            tail = np.repeat(old[lead] + size[old[lead]] - leaving - lead, leaving) + np.arange(len(old))
            from_ = np.repeat(old[lead] + size[old[lead]] - leaving, leaving)
            chosen[pointed] = True
            displaced = sa[tail]
            displaced = displaced[~chosen[displaced]]
            freed = isa[pointed]
            freed = freed[freed < from_]
            chosen[pointed] = False
            sa[freed] = displaced
            isa[displaced] = freed
            sa[tail] = pointed
            isa[pointed] = tail
            size[old[lead]] -= leaving
            born = np.flatnonzero(np.concatenate(([True], (old[1:] != old[:-1]) | (count[1:] != count[:-1]))))
            width = np.diff(np.append(born, len(old)))
            group[pointed] = np.repeat(tail[born], width)
            size[tail[born]] = width
        more = taken > first_of[busy]
        busy, taken = busy[more], taken[more]
        taken = group[sa[taken - 1]]

    out = np.full(n, -1, np.int64)
    free = np.arange(n)
    placed = np.zeros(n, bool)
    out[first_of[sizes > 0]] = base[1:][sizes > 0] - 1
    placed[base[1:][sizes > 0] - 1] = True
    by_size = np.argsort(-sizes, kind="stable")
    first_sorted, size_sorted = first_of[by_size], sizes[by_size]
    for k in range(int(sizes.max()) if len(sizes) else 0):
        live = int(np.searchsorted(-size_sorted, -k, side="left"))
        origin = first_sorted[:live]
        at = out[origin + k] - 1
        at = at[at >= origin]
        at = at[~placed[at]]
        while len(at):
            home = group[at]
            spot = free[home]
            out[spot] = at
            placed[at] = True
            free[home] = spot + 1
            at = previous[at]
            at = at[at >= 0]
            at = at[~placed[at]]
    return out


def equal_windows(text: np.ndarray, base: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, class) of the valid positions whose next ``length`` symbols occur at another valid position of their string.

    In suffix order such positions are neighbours with a common prefix of at least ``length``.
    """
    sa = suffix_arrays(text, base)
    sa = sa[valid[sa]]
    lane = np.searchsorted(base, sa, side="right")
    pair = np.flatnonzero(lane[1:] == lane[:-1])
    for k in range(length):
        pair = pair[text[sa[pair] + k] == text[sa[pair + 1] + k]]
        if not len(pair):
            break
    same = np.zeros(len(sa), bool)
    same[pair] = True  # with the next one
    member = same.copy()
    member[1:] |= same[:-1]
    number = np.cumsum(member & ~np.concatenate(([False], same[:-1])))
    return sa[member], number[member]
