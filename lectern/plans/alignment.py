"""Edit distances and alignments of two sequences, by whole columns of bits.

A column of the distance table is kept as two bit strings: where the distance grows from one row to the next, and where it
falls (Myers 1999, Hyyrö 2003). A step to the next column is a few operations on whole numbers of as many bits as the
first sequence has items, so two lines of 30,000 characters take a fraction of a second. For the way back every `step`-th
column is kept and the columns between are worked out again, so memory grows with the length times its square root, in bits.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence

import numpy as np


#: Items that stand in more places have their bits made once; others, of which there may be many, each time.
FEW = 16


def bits(places: list[int], size: int) -> int:
    """A number with a bit at each place."""
    row = bytearray(size // 8 + 1)
    for k in places:
        row[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(row, "little")


class Columns:
    """Columns of the distance table of a (rows) against items of another sequence."""

    def __init__(self, a: Sequence[Hashable]):
        places: dict[Hashable, list[int]] = {}
        for k, x in enumerate(a):
            places.setdefault(x, []).append(k)
        self.few = {x: p for x, p in places.items() if len(p) <= FEW}
        self.at = {x: bits(p, len(a)) for x, p in places.items() if len(p) > FEW}
        self.full, self.size = (1 << len(a)) - 1, len(a)

    def step(self, up: int, down: int, item: Hashable) -> tuple[int, int, int]:
        """(up, down, level) of the next column; level has a bit where a cell equals the one diagonally before it."""
        here = self.at.get(item)
        if here is None:
            here = bits(self.few[item], self.size) if item in self.few else 0
        level = (((here & up) + up) ^ up) | here | down
        right = down | (self.full & ~(level | up))
        left = level & up
        right = (right << 1) | 1
        left <<= 1
        return (left | (self.full & ~(level | right))) & self.full, right & level & self.full, level & self.full


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """Least number of items to insert, delete or replace."""
    if not a:
        return len(b)
    table = Columns(a)
    up, down = table.full, 0
    for item in b:
        up, down, _ = table.step(up, down, item)
    return len(b) + up.bit_count() - down.bit_count()


def replaced(a: Sequence[Hashable], b: Sequence[Hashable]) -> Counter:
    """How often each (item of a, item of b) is replaced in an alignment of least distance.

    From the end, a step is diagonal (equal or replaced) where that is least, else an item of a is deleted where that is,
    else one of b inserted.
    """
    found: Counter = Counter()
    if not a or not b:
        return found
    table = Columns(a)
    step = max(16, math.isqrt(len(b)))
    kept = [(table.full, 0)]
    up, down = kept[0]
    for j, item in enumerate(b, 1):
        up, down, _ = table.step(up, down, item)
        if j % step == 0:
            kept.append((up, down))
    i, j = len(a), len(b)
    while i and j:
        first = (j - 1) // step  # columns first * step + 1 to j, from the kept one before them
        up, down = kept[first]
        block = []
        for item in b[first * step : j]:
            up, down, level = table.step(up, down, item)
            block.append((up, level))
        while i and j > first * step:
            up, level = block[j - first * step - 1]
            bit = i - 1
            if a[bit] == b[j - 1]:
                i, j = i - 1, j - 1
            elif not level >> bit & 1:
                found[a[bit], b[j - 1]] += 1
                i, j = i - 1, j - 1
            elif up >> bit & 1:
                i -= 1
            else:
                j -= 1
    return found


#: Characters of the pairs that are compared at once.
ROOM = 2_000_000


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _groups(sizes: list[int]) -> Iterator[slice]:
    """Runs of pairs of ROOM characters each, or of one longer pair."""
    first = total = 0
    for k, n in enumerate(sizes):
        if k > first and total + n > ROOM:
            yield slice(first, k)
            first, total = k, 0
        total += n
    if sizes:
        yield slice(first, len(sizes))


def swapped(a: list[str], b: list[str]) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Pairs of which the least alignment is the plain one, place by place, and (pair, x, y) of the places where those differ.

    Such pairs are of one length, and no character that differs on one side is among those that differ on the other. Then no
    multiset of fewer edits turns one into the other (each edit brings in one character at most), so the number of places that
    differ is the distance of the pair and of all its beginnings. Everything is linear in the length. The first
    array is filled while the iterator runs.
    """
    plain = np.zeros(len(a), dtype=bool)
    at = [k for k, (x, y) in enumerate(zip(a, b, strict=True)) if len(x) == len(y)]

    def run() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for part in _groups([len(a[k]) for k in at]):
            rows = at[part]
            left, right = _codes([a[k] for k in rows]), _codes([b[k] for k in rows])
            differ = np.flatnonzero(left != right)
            row = np.searchsorted(np.cumsum([len(a[k]) for k in rows]), differ, side="right")
            x, y = left[differ], right[differ]
            met = np.intersect1d(row << 21 | x, row << 21 | y) >> 21
            good = np.ones(len(rows), dtype=bool)
            good[met] = False
            number = np.array(rows, dtype=np.int64)
            plain[number[good]] = True
            keep = good[row]
            yield number[row[keep]], x[keep], y[keep]

    return plain, run()


def trimmed(a: Sequence, b: Sequence) -> tuple[Sequence, Sequence]:
    """Both without what they share at the start and at the end, which changes no distance."""
    n = min(len(a), len(b))
    start = next((k for k in range(n) if a[k] != b[k]), n)
    end = next((k for k in range(n - start) if a[-1 - k] != b[-1 - k]), n - start)
    return a[start : len(a) - end], b[start : len(b) - end]


def item_edits(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """distance(), in linear time for pairs as in swapped()."""
    a, b = trimmed(a, b)
    if len(a) == len(b):
        apart = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
        if {x for x, _ in apart}.isdisjoint(y for _, y in apart):
            return len(apart)
    return distance(a, b)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """distance() of each pair of strings."""
    plain, parts = swapped(a, b)
    out = np.zeros(len(a), dtype=np.int64)
    for row, _, _ in parts:
        out += np.bincount(row, minlength=len(a))
    for k in np.flatnonzero(~plain):
        out[k] = distance(*trimmed(a[k], b[k]))
    return out


def confused(a: list[str], b: list[str], times: list[int]) -> Counter:
    """replaced() of all pairs added up, each counted so many times."""
    plain, parts = swapped(a, b)
    found: Counter = Counter()
    weights = np.array(times, dtype=np.int64)
    for row, x, y in parts:
        kinds, which = np.unique(x << 21 | y, return_inverse=True)
        sums = np.zeros(len(kinds), dtype=np.int64)
        np.add.at(sums, which, weights[row])
        for kind, n in zip(kinds.tolist(), sums.tolist(), strict=True):
            found[chr(kind >> 21), chr(kind & 0x1FFFFF)] += n
    for k in np.flatnonzero(~plain):
        for pair, n in replaced(a[k], b[k]).items():
            found[pair] += n * times[k]
    return found


# -- shares of matching characters, as difflib.SequenceMatcher(None, a, b).ratio() counts them


def _popular(b: str) -> set[str]:
    """Characters from which difflib starts no block: in 200 characters or more, those that are over one in a hundred."""
    return {c for c in set(b) if b.count(c) > len(b) // 100 + 1} if len(b) >= 200 else set()


def matching(a: str, b: str) -> int:
    """Characters in the matching blocks of SequenceMatcher: the longest block (the first of those), then what is before and behind it.

    Blocks grow from cores without popular characters. Behind a block no core is longer than its own, and before it none is as
    long, so a search ends at the first core of the greatest length left: blocks of one length are found in one pass, where
    SequenceMatcher reads the rest of the text anew for each.
    """
    popular = _popular(b)
    at: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        if c not in popular:
            at.setdefault(c, []).append(j)
    rare = [i for i, c in enumerate(a) if c in at]
    total = 0
    todo = [(0, len(a), 0, len(b), len(a))]
    while todo:
        alo, ahi, blo, bhi, most = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        i, j, size = alo, blo, 0
        before: dict[int, int] = {}
        last = -1
        for k in range(bisect_left(rare, alo), len(rare)) if most else ():
            x = rare[k]
            if x >= ahi or size == most:
                break
            if x != last + 1:
                before = {}
            places, now, last = at[a[x]], {}, x
            for m in range(bisect_left(places, blo), len(places)):
                y = places[m]
                if y >= bhi:
                    break
                n = now[y] = before.get(y - 1, 0) + 1
                if n > size:
                    i, j, size = x - n + 1, y - n + 1, n
                    if size == most:
                        break
            before = now
        core = size
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            todo.append((alo, i, blo, j, max(core - 1, 0)))
            todo.append((i + size, ahi, j + size, bhi, core))
    return total


def _plain_matching(a: str, b: str) -> int | None:
    """matching() in linear time where places are only replaced, by characters that stand nowhere in a, for some that stand nowhere in b.

    A block then has none of these and lies between two differing places, and the same run of a starts first at its own place. So
    all runs of equal places match that hold a core, and the one at the very start. None for other pairs.
    """
    if len(a) != len(b):
        return None
    one, other = set(a), set(b)
    gap = next(c for c in map(chr, range(len(one) + len(other) + 1)) if c not in one and c not in other)
    left, right = a, b
    for c in one - other:
        left = left.replace(c, gap)
    for c in other - one:
        right = right.replace(c, gap)
    if left != right:
        return None
    popular = _popular(b)
    first, *runs = left.split(gap)
    return len(first) + sum(len(run) for run in runs if not popular.issuperset(run))


def ratio(a: str, b: str) -> float:
    """difflib.SequenceMatcher(None, a, b).ratio()."""
    if a == b:
        return 1.0
    found = _plain_matching(a, b)
    return 2.0 * (matching(a, b) if found is None else found) / (len(a) + len(b))
