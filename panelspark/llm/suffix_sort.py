"""Suffix sorting by linear grouping, without renaming or recursion.

Phase one sorts suffixes into groups that share their longest Lyndon prefix.
Groups start as equal first symbols and are processed from the highest down.
For each suffix of the group its previous smaller suffix is found: the walk
to the left steps over suffixes of processed groups by their own pointers.
That suffix's Lyndon prefix grows by the group's, so within its own (lower)
group it moves above those that were not reached, the higher the more often
it was reached.

Phase two emits the order. Suffixes with one Lyndon prefix stand in the order
of what follows it, which is the next smaller suffix; so each emitted suffix
puts those that it follows into the next free place of their groups. They are
met by walking the pointers from the position before it.

Both phases visit each pointer once. A suffix that is a prefix of another
stands before it.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` in lexicographic order."""
    n = len(symbols)
    if n == 0:
        return []
    members: list[list[int]] = []
    group_of = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, s in enumerate(symbols):
        by_symbol.setdefault(s, []).append(i)
    for s in sorted(by_symbol):
        for i in by_symbol[s]:
            group_of[i] = len(members)
        members.append(by_symbol[s])
    above = list(range(1, len(members))) + [-1]
    below = list(range(-1, len(members) - 1))
    done = [False] * len(members)
    previous = [-2] * n

    group = len(members) - 1
    while group >= 0:
        done[group] = True
        own = [i for i in members[group] if group_of[i] == group]
        members[group] = own
        reached: dict[int, int] = {}
        for i in own:
            # Suffixes of this group that are still open are walked as a chain.
            chain = []
            while previous[i] == -2:
                q = i - 1
                while q >= 0 and done[group_of[q]] and previous[q] != -2:
                    q = previous[q]
                if q >= 0 and done[group_of[q]]:
                    chain.append(i)
                    i = q
                    continue
                previous[i] = q
                if q >= 0:
                    reached[q] = reached.get(q, 0) + 1
            for j in reversed(chain):
                q = j - 1
                while q >= 0 and done[group_of[q]]:
                    q = previous[q]
                previous[j] = q
                if q >= 0:
                    reached[q] = reached.get(q, 0) + 1
        if reached:
            moves: dict[int, dict[int, list[int]]] = {}
            for p, times in reached.items():
                moves.setdefault(group_of[p], {}).setdefault(times, []).append(p)
            for low, parts in moves.items():
                at = low
                for times in sorted(parts):
                    new = len(members)
                    members.append(parts[times])
                    done.append(False)
                    for p in parts[times]:
                        group_of[p] = new
                    up = above[at]
                    above.append(up)
                    below.append(at)
                    above[at] = new
                    if up >= 0:
                        below[up] = new
                    at = new
        group = below[group]

    first = 0
    while below[first] >= 0:
        first = below[first]
    free, start, group = [0] * len(members), 0, first
    while group >= 0:
        free[group] = start
        start += len(members[group])
        group = above[group]
    order = [-1] * n
    i = n - 1
    while i >= 0:
        order[free[group_of[i]]] = i
        free[group_of[i]] += 1
        i = previous[i]
    for at in range(n):
        j = order[at]
        i, stop = j - 1, previous[j]
        while i != stop:
            order[free[group_of[i]]] = i
            free[group_of[i]] += 1
            i = previous[i]
    return order


def neighbour_matches(symbols: list[int], order: list[int]) -> list[int]:
    """For each position the length of its longest match with any other position."""
    n = len(symbols)
    rank = [0] * n
    for at, i in enumerate(order):
        rank[i] = at
    longest, size = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + size < n and j + size < n and symbols[i + size] == symbols[j + size]:
                size += 1
            longest[i] = max(longest[i], size)
            longest[j] = max(longest[j], size)
            size = max(0, size - 1)
        else:
            size = 0
    return longest
