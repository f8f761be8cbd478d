"""Sorting suffixes by deep-shallow: multikey quicksort down to a shallow depth, blind tries below it."""

from __future__ import annotations

from bisect import bisect_left, insort


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


def _at(s: bytes, d: int) -> int:
    return s[d] if d < len(s) else -1


def _multikey(strings: list[bytes], rows: list[int], depth: int, shallow: int) -> list[list[int]]:
    """Groups in order; the strings of a group share ``shallow`` bytes, or end together before."""
    out: list[list[int]] = []
    todo = [(rows, depth)]
    while todo:
        some, d = todo.pop()
        if len(some) < 2 or d >= shallow:
            out.append(some)
            continue
        pivot = _at(strings[some[len(some) // 2]], d)
        low, same, high = [], [], []
        for i in some:
            c = _at(strings[i], d)
            (low if c < pivot else high if c > pivot else same).append(i)
        if high:
            todo.append((high, d))
        todo.append((same, shallow if pivot < 0 else d + 1))
        if low:
            todo.append((low, d))
    return out


def _blind_trie(strings: list[bytes], rows: list[int]) -> list[int]:
    """Order by a trie whose inner nodes know only a depth and the byte of each branch there.

    A string is led down by those bytes alone, compared once with the leaf it reaches, and entered where they part.
    """
    root: list = [rows[0]]  # a leaf is a list of equal strings, a node a tuple (depth, branches)
    for i in rows[1:]:
        s = strings[i]
        at = root
        while isinstance(at, tuple):
            branches = at[1]
            at = branches.get(_at(s, at[0])) or next(iter(branches.values()))
        leaf = strings[at[0]]
        n = common(s, leaf)
        if n == len(s) == len(leaf):
            at.append(i)
            continue
        above, at = None, root
        while isinstance(at, tuple) and at[0] <= n:
            above, at = at, at[1].get(_at(s, at[0])) if at[0] < n else at
            if at is above:  # parts at this node's own depth: a new branch
                break
        if above is not None and at is above:
            above[1][_at(s, n)] = [i]
            continue
        node = (n, {_at(leaf, n): at, _at(s, n): [i]})
        if above is None:
            root = node
        else:
            above[1][_at(s, above[0])] = node
    out: list[int] = []
    todo = [root]
    while todo:
        at = todo.pop()
        if isinstance(at, tuple):
            todo.extend(at[1][c] for c in sorted(at[1], reverse=True))
        else:
            out.extend(at)
    return out


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = 32) -> tuple[list[int], list[int]]:
    """Sorted order of strings that share ``depth`` bytes, and the common prefix of each with the next."""
    order: list[int] = []
    for group in _multikey(strings, list(range(len(strings))), depth, depth + shallow):
        order += _blind_trie(strings, group) if len(group) > 1 else group
    return order, [common(strings[a], strings[b]) for a, b in zip(order, order[1:])]


class _RangeMin:
    """Least value between two ranks."""

    def __init__(self, values: list[int]):
        self.levels = [values]
        while len(self.levels[-1]) > (1 << (len(self.levels) - 1)):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append([min(a, b) for a, b in zip(last, last[half:])])

    def __call__(self, a: int, b: int) -> int:
        if a > b:
            a, b = b, a
        k = (b - a).bit_length() - 1
        row = self.levels[k]
        return min(row[a], row[b - (1 << k)])


def extents(order: list[int], lcp: list[int], other: list[int], other_lcp: list[int], need: int) -> list[int]:
    """Per string the largest common extent l on one side with a partner that has need - l or more on the other; -1 if none.

    Strings are joined in falling order of l, small clusters into large ones. A newcomer has to be compared only with its
    neighbours in the other side's order: who is nearer there shares more, and is already known to whoever lies beyond.
    """
    n = len(order)
    best = [-1] * n
    rank = [0] * n
    for r, i in enumerate(other):
        rank[i] = r
    shared = _RangeMin(other_lcp)
    head = list(range(n))
    ranks = [[rank[i]] for i in range(n)]

    def find(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for t in sorted(range(n - 1), key=lcp.__getitem__, reverse=True):
        l, a, b = lcp[t], find(order[t]), find(order[t + 1])
        if len(ranks[a]) < len(ranks[b]):
            a, b = b, a
        large = ranks[a]
        for x in ranks[b]:
            k = bisect_left(large, x)
            for y in large[max(0, k - 1):k + 1]:
                if l + shared(x, y) >= need:
                    i, j = other[x], other[y]
                    if best[i] < 0:
                        best[i] = l
                    if best[j] < 0:
                        best[j] = l
            insort(large, x)
        head[b] = a
        ranks[b] = []
    return best
