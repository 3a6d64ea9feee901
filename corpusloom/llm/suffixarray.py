"""Linear-time suffix sorting by grouping (Baier 2016, "Linear-time suffix sorting").

Suffixes with the same Lyndon prefix form a group. Groups start as those of equal first
symbols and are processed in descending order: each member looks for the nearest place
before it in a smaller group (its previous-smaller pointer, found by following the
pointers of the larger ones), and the places so found are split off their groups, by
how many members lead to them, to just above what remains there. When all
groups are done, a group's members differ only in the suffix after their common prefix,
which is smaller than they are: emitting suffixes in ascending order fills each group
from its start, without renaming or recursion.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in ascending order; a suffix is less than those it begins."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    start = np.argsort(symbols, kind="stable")
    ordered = symbols[start]
    fresh = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    head = np.repeat(fresh, np.diff(np.append(fresh, n)))
    place = np.empty(n, dtype=np.int64)
    place[start] = np.arange(n)
    group = np.empty(n, dtype=np.int64)
    group[start] = head
    size = np.zeros(n, dtype=np.int64)
    size[fresh] = np.diff(np.append(fresh, n))
    order, where, of, count = start.tolist(), place.tolist(), group.tolist(), size.tolist()
    length = [1] * n  # of a group's prefix, by the group's head
    before = [-1] * n
    top = n - 1
    while top >= 0:
        first = of[order[top]]
        members = order[first : top + 1]
        if len(members) > 1:
            members.sort()
        leads: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and of[j] >= first:
                j = before[j]
            before[i] = j
            if j >= 0:
                leads[j] = leads.get(j, 0) + 1
        if leads:
            width = length[first]
            if len(leads) == 1 or len(set(leads.values())) == 1:
                levels = [(next(iter(leads.values())), list(leads))]
            else:
                by_count: dict[int, list[int]] = {}
                for p, c in leads.items():
                    by_count.setdefault(c, []).append(p)
                levels = sorted(by_count.items(), reverse=True)
            for c, places in levels:
                for p in places:
                    g = of[p]
                    left = count[g] - 1
                    count[g] = left
                    last = g + left
                    spot = where[p]
                    if spot != last:
                        other = order[last]
                        order[spot], order[last] = other, p
                        where[other], where[p] = spot, last
                # those moved are now the tail of their group and become a group of their own;
                # a group that is moved whole keeps its head, and only its prefix grows
                whole = set()
                for p in places:
                    g = of[p]
                    new = g + count[g]
                    if new == g:
                        whole.add(g)
                    else:
                        of[p] = new
                        count[new] += 1
                        length[new] = length[g] + c * width
                for p in places if whole else ():
                    if of[p] in whole:
                        count[of[p]] += 1
                for g in whole:
                    length[g] += c * width
        top = first - 1
    out = [0] * n
    filled: dict[int, int] = {}
    k, s = 0, n
    while True:
        j = s - 1
        while j >= 0 and j + length[of[j]] == s:
            g = of[j]
            spot = filled.get(g, g)
            out[spot] = j
            filled[g] = spot + 1
            j = before[j]
        if k == n:
            break
        s = out[k]
        k += 1
    return np.array(out, dtype=np.int64)
