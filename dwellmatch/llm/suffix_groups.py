"""Suffix array by grouping of Lyndon prefixes, for integer strings."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of ``text`` (non-negative integers) in ascending order.

    Suffixes are grouped by their longest Lyndon prefix. Groups start as equal first symbols and
    are taken in descending order: the previous smaller suffix of each member (found along the
    pointers of members of higher groups) has its prefix extended by the member's, so it moves to
    a new group behind its old one, the farther the more members point to it. When all groups are
    done, suffixes are emitted in order: the suffix just emitted ends the Lyndon prefix of those
    whose next smaller suffix it is, and each of these takes its group's next place. Nothing is
    renamed and sorted again. A sentinel below all symbols is added for the run.
    """
    n = len(text) + 1
    if n == 1:
        return np.zeros(0, np.int64)
    symbols = np.empty(n, np.int64)
    symbols[:-1] = text
    symbols[:-1] += 1
    symbols[-1] = 0

    order = np.argsort(symbols, kind="stable")
    ranked = symbols[order]
    first = np.flatnonzero(np.diff(ranked, prepend=-1))
    start_of = np.zeros(n, np.int64)
    start_of[order] = np.repeat(first, np.diff(np.append(first, n)))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)

    at = order.tolist()  # suffixes, group after group
    place = place.tolist()  # where each suffix stands in ``at``
    group = start_of.tolist()  # where each suffix's group starts; ascending as the groups are
    size = [0] * n
    for a, b in zip(first.tolist(), np.diff(np.append(first, n)).tolist()):
        size[a] = b
    previous = [-1] * n

    stop = n
    while stop > 1:
        start = group[at[stop - 1]]
        if start == 0:
            break
        members = at[start:stop]
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            if len(members) == len(pointed):
                levels = (pointed,)
            else:
                by_count: dict[int, list[int]] = {}
                for j, count in pointed.items():
                    by_count.setdefault(count, []).append(j)
                levels = [by_count[c] for c in sorted(by_count, reverse=True)]
            for level in levels:
                moved: dict[int, list[int]] = {}
                for j in level:
                    g = group[j]
                    if g in moved:
                        moved[g].append(j)
                    else:
                        moved[g] = [j]
                for g, suffixes in moved.items():
                    left = size[g] - len(suffixes)
                    size[g] = left
                    if not left:  # all of it moves: the group keeps its place
                        size[g] = len(suffixes)
                        continue
                    new = end = g + left
                    size[new] = len(suffixes)
                    for j in suffixes:
                        group[j] = new
                    # Trade places so that the moved suffixes stand at the group's end.
                    stay = [s for s in at[end : end + len(suffixes)] if group[s] == g]
                    for j in suffixes:
                        if place[j] < end:
                            s, p = stay.pop(), place[j]
                            q = place[s]
                            at[p], place[s] = s, p
                            at[q], place[j] = j, q
        stop = start

    out = [0] * n
    out[0] = n - 1
    placed = [False] * n
    placed[n - 1] = True
    next_place = list(range(n))  # of a group that starts there
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[next_place[g]] = j
            next_place[g] += 1
            placed[j] = True
            j = previous[j]
    return np.array(out[1:], np.int64)
