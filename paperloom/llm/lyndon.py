"""Suffix sorting by linear grouping over Lyndon prefixes.

Suffixes start in groups by their first symbol. Groups are handled from the largest down. The
suffixes of a group point to the nearest suffix before them in a smaller group; that one's Lyndon
prefix goes on with the group's, so it moves up within its own group, behind those that are not
pointed to, further the more of the group point to it. When all groups are handled, suffixes
share a group only if they share their longest Lyndon prefix. The order inside the groups is then
emitted in one ascending pass: every suffix in turn places the suffix before it, and those that
it points back to, at the next free place of their groups. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order; the end is smaller than every symbol."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    # The end of the text is a suffix of its own, the smallest.
    codes = np.append(np.unique(symbols, return_inverse=True)[1] + 1, 0)
    order = np.argsort(codes, kind="stable")
    first = np.searchsorted(codes[order], codes)
    group, back = _grouped(order.tolist(), first.tolist())
    return np.array(_emitted(group, back), np.int64)[1:]


def _grouped(order: list[int], group: list[int]) -> tuple[list[int], list[int]]:
    """Each suffix's final group, named by its first place, and the suffix it points back to."""
    n = len(order)
    place = [0] * n
    for k, i in enumerate(order):
        place[i] = k
    end_of = {}
    for i in order:
        end_of[group[i]] = end_of.get(group[i], group[i]) + 1
    back = [-1] * n
    end = n
    while end > 0:
        here = group[order[end - 1]]
        members = order[here:end] if end - here == 1 else sorted(order[here:end])
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= here:
                j = back[j]
            back[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = here
        if not pointed:
            continue
        if len(pointed) == 1:
            moved = {group[j]: [j] for j in pointed}
        else:
            moved = {}
            for j in sorted(pointed, key=pointed.__getitem__):
                moved.setdefault(group[j], []).append(j)
        for old, js in moved.items():
            stop = end_of[old]
            start = stop - len(js)
            if start > old:
                # Those at the tail that stay change places with those that move there.
                going = set(js) if len(js) > 1 else js
                free = [place[j] for j in js if place[j] < start]
                if free:
                    for k in range(start, stop):
                        i = order[k]
                        if i not in going:
                            k2 = free.pop()
                            order[k2] = i
                            place[i] = k2
                end_of[old] = start
            times, new = 0, start
            for k, j in enumerate(js, start):
                order[k] = j
                place[j] = k
                if pointed[j] != times:
                    if times:
                        end_of[new] = k
                    times, new = pointed[j], k
                group[j] = new
            end_of[new] = stop
    return group, back


def _emitted(group: list[int], back: list[int]) -> list[int]:
    n = len(group)
    out = [0] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    free = list(range(n))
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            j = back[j]
    return out
