"""Suffix arrays by linear grouping construction."""

from __future__ import annotations


def suffix_array(text: bytes) -> list[int]:
    """Starts of the suffixes of ``text`` in order; a suffix sorts before those that it begins.

    First phase: suffixes stand in groups by what is known of their Lyndon
    prefix, at first one byte.  Groups are taken in descending order; a
    member's previous-smaller pointer leads to the nearest earlier suffix in a
    lower group, whose known prefix ends where the member's begins and so
    grows by the group's.  Such suffixes move to new groups just above their
    old one, the more copies they take the higher.  Second phase: in ascending
    order, each suffix found puts those whose Lyndon prefix ends at it into
    the next place of their groups.  Nothing is renamed or sorted again.
    """
    n = len(text)
    if not n:
        return []
    members: list[list[int]] = []
    below: list[int] = []
    above: list[int] = []
    group = [0] * n
    places: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        places.setdefault(c, []).append(i)
    for g, c in enumerate(sorted(places)):
        members.append(places[c])
        below.append(g - 1)
        above.append(g + 1)
        for i in places[c]:
            group[i] = g
    now = len(members) - 1
    above[now] = -1
    length, before, done = [1] * n, [-1] * n, bytearray(n)
    ordered: list[list[int]] = []
    while now >= 0:
        own = [i for i in members[now] if group[i] == now]
        if own:
            ordered.append(own)
            for i in own:
                done[i] = 1
            copies: dict[int, int] = {}
            for i in own:
                j = i - 1
                while j >= 0 and done[j]:
                    j = before[j]
                before[i] = j
                if j >= 0:
                    copies[j] = copies.get(j, 0) + 1
            grown = length[own[0]]
            moved: dict[tuple[int, int], list[int]] = {}
            for j, k in copies.items():
                length[j] += k * grown
                key = (group[j], k)
                if key in moved:
                    moved[key].append(j)
                else:
                    moved[key] = [j]
            for old, k in sorted(moved, reverse=True) if len(moved) > 1 else moved:
                # the largest k first: each later one goes between it and the old group
                new, upper = len(members), above[old]
                members.append(moved[old, k])
                below.append(old)
                above.append(upper)
                above[old] = new
                if upper >= 0:
                    below[upper] = new
                for j in moved[old, k]:
                    group[j] = new
        members[now] = []
        now = below[now]
    free, at = [0] * len(members), 0
    for own in reversed(ordered):
        free[group[own[0]]] = at
        at += len(own)
    out = [0] * n
    at, end = -1, n
    while True:
        i = end - 1
        while i >= 0 and i + length[i] == end:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            i = before[i]
        at += 1
        if at == n:
            return out
        end = out[at]
