"""Suffix arrays of many short strings at once, by grouping."""

from __future__ import annotations

import numpy as np

#: Strings left in a pass that are taken one by one.
FEW = 12


def suffix_arrays(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places of all suffixes, string by string, each string's in ascending order.

    symbols: the strings one behind the other; string s is symbols[begin[s]:begin[s + 1]].

    First the suffixes of a string lie in groups by their first symbol. The groups are processed in descending order. A
    suffix of the group at hand gets a pointer to the previous smaller one: the last place before it whose suffix lies in
    a lower group. Those that are pointed at are followed by the group's prefix, so their own prefix grows by it, once for each
    pointer: they leave their group for new ones above what stays, those with more pointers higher up. In the end
    each group holds the suffixes of one Lyndon prefix. Then one pass up each string emits the order in the groups: a suffix in
    its place puts the one before it, and on along the pointers, into the next free place of their groups. No group is ever
    renamed or sorted again. All strings go one step at a time together, so that a step is a few array operations.
    """
    n, size = len(symbols), np.diff(begin)
    string = np.repeat(np.arange(len(size), dtype=np.int64), size)
    sa = np.argsort(narrow(symbols), kind="stable")
    sa = sa[np.argsort(narrow(string)[sa], kind="stable")]
    head = np.r_[True, (symbols[sa][1:] != symbols[sa][:-1]) | (string[sa][1:] != string[sa][:-1])][:n]
    starts = np.flatnonzero(head)
    group, place, stop = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    group[sa] = np.repeat(starts, np.diff(np.r_[starts, n]))
    place[sa] = np.arange(n)
    stop[starts] = np.r_[starts[1:], n]
    prev, mark = np.full(n, -1, np.int64), np.zeros(n, bool)
    top, going = begin[1:].copy(), np.flatnonzero(size)
    while len(going):
        high = top[going]
        low = group[sa[high - 1]]
        many = high - low
        i = np.sort(sa[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())])
        floor, first = np.repeat(low, many), np.repeat(begin[going], many)
        p = np.where(i > first, i - 1, -1)
        todo = np.flatnonzero(p >= 0)
        while len(todo):
            todo = todo[group[p[todo]] > floor[todo]]
            p[todo] = prev[p[todo]]
            todo = todo[p[todo] >= 0]
        prev[i] = p
        todo = np.flatnonzero(p >= 0)
        while len(todo):
            todo = todo[group[p[todo]] == floor[todo]]
            p[todo] = prev[p[todo]]
            prev[i[todo]] = p[todo]
            todo = todo[p[todo] >= 0]
        at, times = np.unique(p[p >= 0], return_counts=True)
        if len(at):
            order = np.lexsort((times, group[at]))
            at, times = at[order], times[order]
            own = group[at]
            lead = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out = np.diff(np.r_[lead, len(at)])
            tail = stop[own[lead]] - out
            to = np.repeat(tail - lead, out) + np.arange(len(at))
            mark[at] = True
            there = sa[to]
            stay, free = there[~mark[there]], place[at][place[at] < np.repeat(tail, out)]
            mark[at] = False
            sa[free], place[stay] = stay, free
            sa[to], place[at] = at, to
            sub = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (times[1:] != times[:-1])])
            length = np.diff(np.r_[sub, len(at)])
            stop[own[lead]] = tail
            stop[to[sub]] = to[sub] + length
            group[at] = np.repeat(to[sub], length)
        top[going] = low
        going = going[low > begin[going]]
    free, done = np.arange(n, dtype=np.int64), np.zeros(n, bool)
    by_size = np.argsort(-size, kind="stable")
    ends = np.sort(size)
    count = len(size) - np.searchsorted(ends, np.arange(ends[-1] if len(ends) else 0), "right")
    for step, many in enumerate(count.tolist()):
        live = by_size[:many]
        if many <= FEW:
            for b, e in zip(begin[live].tolist(), begin[live + 1].tolist(), strict=True):
                emit_rest(sa, group, prev, free, done, b, e, step)
            break
        p = (sa[begin[live] + step - 1] if step else begin[live + 1]) - 1
        p = p[p >= begin[live]]
        while len(p):
            p = p[~done[p]]
            slot = group[p]
            sa[free[slot]] = p
            free[slot] += 1
            done[p] = True
            p = prev[p]
            p = p[p >= 0]
    return sa


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in 16 bits where these hold them: sorting them is linear then."""
    return values.astype(np.uint16) if len(values) and values.min() >= 0 and values.max() < 1 << 16 else values


def emit_rest(sa: np.ndarray, group: np.ndarray, prev: np.ndarray, free: np.ndarray, done: np.ndarray, b: int, e: int, step: int) -> None:
    """The pass over the string from b to e, from `step` on, one suffix after the other: for strings much longer than the others."""
    out, slots, before, place, ready = (x[b:e].tolist() for x in (sa, group, prev, free, done))
    for k in range(step, e - b):
        p = (out[k - 1] if k else e) - 1
        while p >= b and not ready[p - b]:
            slot = slots[p - b] - b
            out[place[slot] - b] = p
            place[slot] += 1
            ready[p - b] = True
            p = before[p - b]
    sa[b:e] = out
