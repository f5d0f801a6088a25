"""Linear grouping construction of a suffix array.

Suffixes are grouped by their Lyndon prefix, the longest prefix that is smaller than all of its
proper suffixes. Groups are taken from the largest down; a group's members point to the nearest
earlier suffix of a smaller group, and what they point to moves to new groups of longer prefixes.
The final groups are in order, and one pass over the suffix array puts each group's members in order.
"""

from __future__ import annotations

from collections.abc import Sequence


def _by_symbol(text: Sequence[int]) -> list[list[int]]:
    """Positions by symbol, in the order of the symbols; symbols near the text's length at most are counted out."""
    top = max(text, default=-1)
    if min(text, default=0) < 0 or top > 4 * len(text) + 1024:
        kinds = {symbol: k for k, symbol in enumerate(sorted(set(text)))}
        text, top = [kinds[symbol] for symbol in text], len(kinds) - 1
    found: list[list[int]] = [[] for _ in range(top + 1)]
    for i, symbol in enumerate(text):
        found[symbol].append(i)
    return [f for f in found if f]


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of ``text`` in order; a proper prefix comes before what it begins."""
    n = len(text)
    members: dict[int, set[int]] = {}
    group = [0] * n  # the place in the suffix array where a suffix's group begins: larger group, larger place
    at = 0
    for found in _by_symbol(text):
        members[at] = set(found)
        for i in found:
            group[i] = at
        at += len(found)

    earlier = [-1] * n  # nearest earlier suffix of a smaller group
    # Below a group that is being taken, groups are only split; the next one down ends where it begins.
    top = n
    begins = list(members)
    while begins:
        own = begins.pop()
        while top - own > len(members[own]):  # split since: its later parts come first
            begins.append(own)
            own += len(members[own])
        pointed: dict[int, int] = {}
        for i in members[own]:
            j = i - 1
            while j >= 0 and group[j] > own:
                j = earlier[j]
            earlier[i] = j  # of a smaller group or this one
        # Members that point to members: each chain is followed once, then points to its end.
        open_ = set(members[own])
        while open_:
            i = open_.pop()
            chain = [i]
            j = earlier[i]
            while j in open_:
                open_.remove(j)
                chain.append(j)
                j = earlier[j]
            if j >= 0 and group[j] == own:
                j = earlier[j]
            for i in chain:
                earlier[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + len(chain)
        top = own
        moved: dict[int, list[tuple[int, int]]] = {}
        for j, times in pointed.items():
            moved.setdefault(group[j], []).append((times, j))
        for old, found in moved.items():
            stay = members[old]
            if len(found) == len(stay) and all(t == found[0][0] for t, _ in found):
                continue  # the whole group goes on together
            by_times: dict[int, set[int]] = {}
            for times, j in found:
                by_times.setdefault(times, set()).add(j)
            end = old + len(stay)
            # Different numbers of pointers are few: no more than the root of twice all pointers.
            for times in sorted(by_times, reverse=True):
                part = by_times[times]
                if len(part) == len(stay):
                    break  # nothing smaller stays behind
                stay -= part
                end -= len(part)
                members[end] = part
                for j in part:
                    group[j] = end

    order = [-1] * n
    placed = [False] * n
    free: dict[int, int] = {}

    def settle(j: int) -> None:
        """Places the suffixes whose next smaller suffix is the one after ``j``."""
        while j >= 0 and not placed[j]:
            g = group[j]
            k = free.get(g, g)
            order[k] = j
            free[g] = k + 1
            placed[j] = True
            j = earlier[j]

    settle(n - 1)
    for k in range(n):
        settle(order[k] - 1)
    return order
