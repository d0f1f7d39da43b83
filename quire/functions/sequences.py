"""What two sequences have in common, in work that grows with their differences."""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np

#: Every so many fronts one is kept; those between are made again when they are asked for.
EVERY = 64
#: Items compared at once along a diagonal, at most; diagonals that are walked item by item instead.
STRIDE, FEW = 1_024, 16


class Fronts:
    """From the ends of two sequences: how many items of the first are behind, at most, on each diagonal after d edits.

    A diagonal is the difference of the numbers of items behind; an edit passes one item of one sequence, and equal
    items are passed by both for nothing.  Each front follows from the one before over all diagonals at once.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.ascontiguousarray(x[::-1]), np.ascontiguousarray(y[::-1])
        self.items = self.x.tolist(), self.y.tolist()
        front, d = self._along(np.zeros(1, np.int64), np.zeros(1, np.int64)), 0
        self.kept, self.block = {0: front}, {}
        end = len(x) - len(y)
        while abs(end) > d or (end + d) % 2 or front[(end + d) // 2] < len(x):
            d += 1
            front = self._next(front, d)
            if d % EVERY == 0:
                self.kept[d] = front
        self.edits = d

    def _next(self, front: np.ndarray, d: int) -> np.ndarray:
        none = np.full(1, -1 << 40)
        diagonal = np.arange(-d, d + 1, 2)
        by_x, by_y = np.concatenate([none, front + 1]), np.concatenate([front, none])
        by_x[by_x > len(self.x)] = by_y[by_y - diagonal > len(self.y)] = none
        return self._along(np.maximum(by_x, by_y), diagonal)

    def _same(self, u: np.ndarray, v: np.ndarray, width: int) -> np.ndarray:
        """Whether the next ``width`` items are there and equal."""
        ok = (u + width <= len(self.x)) & (v + width <= len(self.y))
        at = np.flatnonzero(ok)
        step = np.arange(width)
        ok[at] = (self.x[u[at, None] + step] == self.y[v[at, None] + step]).all(axis=1)
        return ok

    def _along(self, u: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Each place moved along its diagonal over all equal items, in strides that double and then halve."""
        if len(u) <= FEW:
            x, y = self.items
            for k, (at, off) in enumerate(zip(u.tolist(), diagonal.tolist(), strict=True)):
                while 0 <= at < len(x) and at - off < len(y) and x[at] == y[at - off]:
                    at += 1
                u[k] = at
            return u
        going, width, stopped = np.flatnonzero(u >= 0), 1, []
        while len(going):
            ok = self._same(u[going], u[going] - diagonal[going], width)
            u[going[ok]] += width
            if width > 1:
                stopped.append((width, going[~ok]))
            going, width = going[ok], min(2 * width, STRIDE)
        while stopped and (width := max(w for w, _ in stopped)) > 1:
            at = np.concatenate([k for w, k in stopped if w == width])
            stopped = [x for x in stopped if x[0] < width]
            ok = self._same(u[at], u[at] - diagonal[at], width // 2)
            u[at[ok]] += width // 2
            stopped.append((width // 2, at))
        return u

    def __getitem__(self, d: int) -> np.ndarray:
        if d not in self.block:
            at = d // EVERY * EVERY
            self.block = {at: self.kept[at]}
            while at < d:
                self.block[at + 1] = self._next(self.block[at].copy(), at + 1)
                at += 1
        return self.block[d]


#: Pairs of items up to which two lists are aligned by rows of bits, an integer for each item of the first.
BIT_PAIRS = 1 << 22


def _matched_by_bits(a: list, b: list) -> tuple[list[bool], list[bool]]:
    """``matched_flags`` of short lists.

    A row has a bit for each item of the second list from its end on; those not set, among the last so many, count what the
    rest of the first list has in common with them.
    """
    held: dict = {}
    for k, item in enumerate(reversed(b)):
        held[item] = held.get(item, 0) | 1 << k
    in_a, in_b = [False] * len(a), [False] * len(b)
    own = [k for k, item in enumerate(a) if item in held]
    i = j = 0
    while i < len(own) and j < len(b) and a[own[i]] == b[j]:
        in_a[own[i]] = in_b[j] = True
        i, j = i + 1, j + 1
    most = (1 << len(b)) - 1
    rows, row = [most], most
    for k in reversed(own[i:]):
        u = row & held[a[k]]
        row = (row + u | row - u) & most
        rows.append(row)
    rows.reverse()
    begun, left = i, len(b) - j
    common = left - (rows[0] & (1 << left) - 1).bit_count()
    while common:
        if a[own[i]] == b[j]:
            in_a[own[i]] = in_b[j] = True
            i, j, common = i + 1, j + 1, common - 1
        elif (left := len(b) - j) - (rows[i + 1 - begun] & (1 << left) - 1).bit_count() == common:
            i += 1
        else:
            j += 1
    return in_a, in_b


def matched_flags(a: list, b: list) -> tuple[list[bool], list[bool]]:
    """Which items a longest common subsequence matches; where two are as long, the first list is advanced.

    Memory grows with the lists and the square of the edits over EVERY, time with the edits times their diagonals; short
    lists, for which fronts cost more than they save, are aligned by rows of bits.
    """
    if len(a) * len(b) <= BIT_PAIRS:
        return _matched_by_bits(a, b)
    code: dict = {}
    x, y = (np.array([code.setdefault(i, len(code)) for i in items], np.int64) for items in (a, b))
    in_a, in_b = np.zeros(len(x), bool), np.zeros(len(y), bool)
    # what only the first list holds is passed at once wherever it stands
    own = np.flatnonzero(np.isin(x, y))
    x = x[own]
    if len(x) and len(y):
        fronts, i, j = Fronts(x, y), 0, 0
        for d in range(fronts.edits, -1, -1):
            while i < len(x) and j < len(y) and x[i] == y[j]:
                run = min(len(x) - i, len(y) - j, STRIDE)
                unlike = np.flatnonzero(x[i : i + run] != y[j : j + run])
                run = int(unlike[0]) if len(unlike) else run
                in_a[own[i : i + run]] = in_b[j : j + run] = True
                i, j = i + run, j + run
            if d:
                left = len(x) - i - 1  # behind, if the first list is advanced
                place = left - (len(y) - j) + d - 1
                if left >= 0 and 0 <= place <= 2 * (d - 1) and fronts[d - 1][place // 2] >= left:
                    i += 1
                else:
                    j += 1
    return in_a.tolist(), in_b.tolist()


def alike_pairs(left: list[frozenset], right: list[frozenset], least: float):
    """(Jaccard similarity, place in left, place in right) of all pairs from ``least`` on, one after the other; two empty sets are alike.

    Tokens are ordered by rising frequency.  Sets that are alike enough share one of the first tokens of each, so
    only these are looked up, and sizes that are too far apart are passed over; what is left is compared exactly.
    Equal sets are compared once, however often they occur.
    """
    places: tuple[dict, dict] = {}, {}
    for at, sets in zip(places, (left, right), strict=True):
        for k, s in enumerate(sets):
            at.setdefault(s, []).append(k)
    one, other = (list(at) for at in places)
    often = Counter(t for s in (*one, *other) for t in s)
    order = {t: i for i, t in enumerate(sorted(often, key=lambda t: (often[t], t)))}

    def first(s: frozenset) -> list:
        return sorted(s, key=order.__getitem__)[: len(s) - ceil(least * len(s) - 1e-9) + 1]

    holders: dict = {}
    for r, s in enumerate(other):
        for t in first(s):
            holders.setdefault(t, []).append(r)
    for s in one:
        if s:
            near = {r for t in first(s) for r in holders.get(t, ()) if least * len(s) <= len(other[r]) + 1e-9 and least * len(other[r]) <= len(s) + 1e-9}
            met = [(other[r], len(s & other[r])) for r in near]
        else:
            met = [(s, 0)]
        for t, k in met:
            score = k / (len(s) + len(t) - k) if s else 1.0
            if score >= least:
                yield from ((score, a, r) for a in places[0][s] for r in places[1].get(t, ()))


def alike_sets(left: list[frozenset], right: list[frozenset], least: float) -> list[tuple[float, int, int]]:
    """The pairs of ``alike_pairs`` as a list."""
    return list(alike_pairs(left, right, least))


def one_to_one(scores: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of scored pairs the best one by one, each side used once; by falling score, then place."""
    out, used = [], (set(), set())
    for s, a, r in sorted(scores, key=lambda x: (-x[0], x[1], x[2])):
        if a not in used[0] and r not in used[1]:
            out.append((s, a, r))
            used[0].add(a)
            used[1].add(r)
    return out
