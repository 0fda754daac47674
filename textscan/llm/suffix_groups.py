"""Suffix arrays by linear grouping, for many short texts at once.

First the suffixes are grouped by their first sign.  Groups are taken from the highest down.  Each suffix of the
group points to the nearest suffix before it that is in a lower group (its previous smaller suffix), and those
that are pointed at go behind the others of their own group, in the order of how many pointers they got.  When
all groups are done, the suffixes of a group share their longest Lyndon prefix.  Then the order inside the groups
is emitted from the least suffix on: each placed suffix places the one before it, and what that points at, in the
next free place of its group.  Nothing is renamed and nothing is sorted recursively.

A step of the loop takes the next group of every text, so the work of a step is done in whole arrays.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges, one range behind the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _by_first_sign(signs: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes by text and first sign, start of each suffix's group, end of the group by its start)."""
    order = np.argsort(signs, kind="stable")
    order = order[np.argsort(text_of[order], kind="stable")]
    key = text_of[order].astype(np.int64) << 16 | signs[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sizes = np.diff(np.append(starts, len(order)))
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(starts, sizes)
    end = np.zeros(len(order) + 1, np.int64)
    end[starts] = starts + sizes
    return order, group, end


def suffix_arrays(signs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffixes of texts that lie one behind the other, in the order of their text and then their own.

    ``signs`` are unsigned 16-bit, ``sizes`` the lengths of the texts.  A text ends with a sign that is lower
    than all its others.
    """
    n = len(signs)
    if not n:
        return np.array([], np.int64)
    first = np.cumsum(sizes) - sizes
    order, group, end = _by_first_sign(signs, np.repeat(np.arange(len(sizes), dtype=np.int64), sizes))
    # place n stands for "nothing before": it is in a lower group than all
    group = np.append(group, -1)
    before = np.arange(-1, n)
    before[first] = n
    before[n] = n
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    got = np.zeros(n + 1, np.int64)
    left = first + sizes
    while True:
        open_texts = np.flatnonzero(left > first)
        if not len(open_texts):
            break
        low = group[order[left[open_texts] - 1]]
        size = left[open_texts] - low
        members, lows = order[_ranges(low, size)], np.repeat(low, size)
        left[open_texts] = low
        _point(members, lows, group, before)
        target = before[members]
        target = target[target < n]
        if len(target):
            _move_up(target, order, at, group, end, got)
    return _emit(first, sizes, group, before)


def _point(members: np.ndarray, lows: np.ndarray, group: np.ndarray, before: np.ndarray) -> None:
    """Let each member point at the nearest place before it in a lower group: pointers of higher groups are known,
    and those of the same group are doubled."""
    todo = np.flatnonzero(group[before[members]] >= lows)
    members, lows = members[todo], lows[todo]
    while len(members):
        there = before[before[members]]
        before[members] = there
        more = group[there] >= lows
        members, lows = members[more], lows[more]


def _move_up(target: np.ndarray, order: np.ndarray, at: np.ndarray, group: np.ndarray, end: np.ndarray, got: np.ndarray) -> None:
    """Put the suffixes that are pointed at behind the others of their group, by their number of pointers."""
    np.add.at(got, target, 1)
    target = np.unique(target)
    count, home = got[target], group[target]
    by = np.lexsort((count, home))
    target, count, home = target[by], count[by], home[by]
    new_home = np.concatenate(([True], home[1:] != home[:-1]))
    heads = np.flatnonzero(new_home)
    many = np.diff(np.append(heads, len(home)))
    homes = home[heads]
    tails = end[homes] - many
    places = _ranges(tails, many)
    # what stands in the tail without being pointed at changes places with what is pointed at and stands before it
    there = order[places]
    out = there[got[there] == 0]
    free = at[target]
    free = free[free < np.repeat(tails, many)]
    order[free] = out
    at[out] = free
    order[places] = target
    at[target] = places
    got[target] = 0
    runs = np.flatnonzero(new_home | np.concatenate(([True], count[1:] != count[:-1])))
    lengths = np.diff(np.append(runs, len(home)))
    end[homes] = tails
    end[places[runs]] = places[runs] + lengths
    group[target] = np.repeat(places[runs], lengths)


def _emit(first: np.ndarray, sizes: np.ndarray, group: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The order of all suffixes from their groups and pointers."""
    n = int(sizes.sum())
    out = np.full(n + 1, n, np.int64)
    free = np.arange(n + 1)  # by the start of a group: its next free place
    placed = np.zeros(n + 1, bool)
    placed[n] = True
    ends = first + sizes
    out[first] = ends - 1  # the last sign is the least suffix
    placed[ends - 1] = True
    free[group[ends - 1]] += 1
    previous = np.arange(-1, n)
    previous[first] = n
    i, stop = first.copy(), ends
    j = previous[out[i]]
    while len(i):
        done = placed[j]
        go = np.flatnonzero(~done)
        here = j[go]
        home = group[here]
        out[free[home]] = here
        free[home] += 1
        placed[here] = True
        j[go] = before[here]
        if len(go) < len(j):
            halt = np.flatnonzero(done)
            i[halt] += 1
            over = i[halt] >= stop[halt]
            if over.any():
                keep = np.ones(len(i), bool)
                keep[halt[over]] = False
                halt = halt[~over]
                j[halt] = previous[out[i[halt]]]
                i, stop, j = i[keep], stop[keep], j[keep]
            else:
                j[halt] = previous[out[i[halt]]]
    return out[:n]
