"""How many characters of texts longest matching blocks find in one other text, which is prepared once.

The blocks are those of the standard library's SequenceMatcher without junk: the
longest common substring, the earliest in the first text and then in the second
one, and the same again to the left and to the right of it. A suffix automaton of
the second text is built once; a step over a section is one walk through the
automaton, where the matcher pairs each character with all its places.
"""

from __future__ import annotations

import numpy as np

#: Characters from which the automaton, with some 700 bytes for each, gives way to searches in the text itself.
LARGE = 100_000
#: Pairs of characters up to which they are held as bits of one number.
CELLS = 1 << 24


class Automaton:
    """Suffix automaton with, for each state, the places where its strings end."""

    def __init__(self, text: str) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        own = []  # the state that is new with each character
        for at, c in enumerate(text):
            now = self._state(self.length[last] + 1, at)
            own.append(now)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[now] = q
                else:
                    twin = self._state(self.length[p] + 1, self.first[q])
                    self.next[twin], self.link[twin] = dict(self.next[q]), self.link[q]
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now
        self._ends(own)

    def _state(self, length: int, first: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _ends(self, own: list[int]) -> None:
        """Places in the order of a walk through the tree of links: those of a state are neighbours, ``low`` to ``high``."""
        n = len(self.next)
        size = np.zeros(n, np.int64)
        size[own] = 1
        order = np.argsort(self.length, kind="stable")
        for v in order[:0:-1]:
            size[self.link[v]] += size[v]
        free, low = np.zeros(n, np.int64), np.zeros(n, np.int64)
        place = {v: at for at, v in enumerate(own)}
        ends = np.zeros(len(own), np.int64)
        for v in order:
            if v:
                low[v] = free[self.link[v]]
                free[self.link[v]] += size[v]
            free[v] = low[v]
            if v in place:
                ends[low[v]] = place[v]
                free[v] += 1
        self.low, self.high, self.ends = low.tolist(), (low + size).tolist(), ends

    def end(self, state: int, least: int, most: int) -> int:
        """The first place in [least, most) where strings of the state end, or -1."""
        if self.first[state] >= least:
            return self.first[state] if self.first[state] < most else -1
        ends = self.ends[self.low[state] : self.high[state]]
        ends = ends[(ends >= least) & (ends < most)]
        return int(ends.min()) if len(ends) else -1

    def longest(self, a: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(place in a, place in the text, length) of the longest common substring of two ranges, the earliest one."""
        best = (alo, blo, 0)
        state = n = 0
        for i in range(alo, ahi):
            while True:
                to = self.next[state].get(a[i])
                end = self.end(to, blo + n, bhi) if to is not None else -1
                if end >= 0:
                    state, n = to, n + 1
                    if n > best[2]:
                        best = (i - n + 1, end - n + 1, n)
                    break
                if not n:
                    break
                n -= 1  # what is left is shorter by its first character
                if n <= self.length[self.link[state]]:
                    state = self.link[state]
        return best


class Searched:
    """The same by searches in the text: no memory beside it."""

    def __init__(self, text: str) -> None:
        self.text = text

    def longest(self, a: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        best, i = (alo, blo, 0), alo
        while i + best[2] < ahi:
            at = self.text.find(a[i : i + best[2] + 1], blo, bhi)
            if at >= 0:
                best = (i, at, best[2] + 1)
            else:
                i += 1
        return best


class Corpus:
    """One text that many sections are held against."""

    def __init__(self, text: str, large: int = LARGE) -> None:
        self.text = text
        self.index = Automaton(text) if len(text) < large else Searched(text)

    def matched(self, section: str) -> int:
        """Characters in the matching blocks of the section and the text."""
        if section in self.text:
            return len(section)
        todo, total = [(0, len(section), 0, len(self.text))], 0
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            i, j, n = self.index.longest(section, alo, ahi, blo, bhi)
            if n:
                total += n
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j))
                if i + n < ahi and j + n < bhi:
                    todo.append((i + n, ahi, j + n, bhi))
        return total


class Grid:
    """Where two texts have equal characters, as the bits of one number: a row for each character of ``a``, so that runs on diagonals come from shifts."""

    def __init__(self, a: str, b: str) -> None:
        width = len(b) // 8 + 1  # a bit at least is free at the end of a row, where runs end
        at: dict[str, int] = {}
        for j, c in enumerate(b):
            at[c] = at.get(c, 0) | 1 << j
        rows, none = {c: x.to_bytes(width, "little") for c, x in at.items()}, bytes(width)
        self.rows, self.width = b"".join([rows.get(c, none) for c in a]), width

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """(place in a, place in b, length) of the longest common substring of two ranges, the earliest one."""
        width = self.width
        columns = ((1 << bhi) - (1 << blo)).to_bytes(width, "little")
        now = int.from_bytes(self.rows[alo * width : ahi * width], "little") & int.from_bytes(columns * (ahi - alo), "little")
        if not now:
            return alo, blo, 0
        step, n = 8 * width + 1, 1
        runs = []  # where runs of 1, 2, 4, ... begin
        while longer := now & (now >> n * step):
            runs.append(now)
            now, n = longer, 2 * n
        for k in range(len(runs) - 1, -1, -1):
            if longer := now & (runs[k] >> n * step):
                now, n = longer, n + (1 << k)
        i, j = divmod((now & -now).bit_length() - 1, 8 * width)
        return alo + i, j, n


class Hashes:
    """Hashes of all parts of two texts, by which the longest common one of two large ranges is found; what they find is compared."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = a, b
        powers = np.full(max(len(a), len(b)) + 1, self.BASE, np.uint64)
        powers[0] = 1
        self.powers = np.multiply.accumulate(powers)
        self.sums = [self._sums(t) for t in (a, b)]

    def _sums(self, t: str) -> np.ndarray:
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        codes = codes * np.uint64(0xD6E8FEB86659FD93)
        codes ^= codes >> np.uint64(32)
        return np.append(np.uint64(0), np.add.accumulate(codes * self.powers[: len(t)]))

    def _parts(self, side: int, low: int, high: int, n: int) -> np.ndarray:
        """Of each part of ``n`` characters of a range its hash, moved to the place where all have the same power."""
        sums = self.sums[side]
        return (sums[low + n : high + 1] - sums[low : high + 1 - n]) * self.powers[::-1][low : high + 1 - n]

    def longest(self, alo: int, ahi: int, blo: int, bhi: int, most: int) -> tuple[int, int, int] | None:
        """(place in a, place in b, length) of the longest common substring of two ranges, of ``most`` characters at most, the earliest one; None if hashes mislead."""
        low, high, best = 0, min(most, ahi - alo, bhi - blo), (alo, blo, 0)
        n = min(high, 32)
        while low < high:
            x, y = self._parts(0, alo, ahi, n), self._parts(1, blo, bhi, n)
            order = np.sort(y)
            found = order[np.minimum(np.searchsorted(order, x), len(order) - 1)] == x
            if found.any():
                i = int(found.argmax())
                low, best = n, (alo + i, blo + int((y == x[i]).argmax()), n)
                n = min(high, 2 * n) if high > 4 * n else (low + high + 1) // 2
            else:
                high = n - 1
                n = (low + high + 1) // 2
        i, j, n = best
        return best if self.a[i : i + n] == self.b[j : j + n] else None


def _matched_long(a: str, b: str, least: int) -> int:
    """As :func:`matched`: large ranges are split by hashes, smaller ones are left to their own grids."""
    hashes, total, possible = Hashes(a, b), 0, min(len(a), len(b))
    todo = [(0, len(a), 0, len(b), possible)]
    while todo:
        if possible < least:
            return -1
        alo, ahi, blo, bhi, most = todo.pop()
        possible -= min(ahi - alo, bhi - blo)
        if (ahi - alo) * (bhi - blo) <= CELLS:
            n = matched(a[alo:ahi], b[blo:bhi])
            total, possible = total + n, possible + n
            continue
        best = hashes.longest(alo, ahi, blo, bhi, most)
        if best is None:
            return Corpus(b).matched(a)
        i, j, n = best
        if n:
            total, possible = total + n, possible + n
            for x in ((alo, i, blo, j, n), (i + n, ahi, j + n, bhi, n)):
                if x[0] < x[1] and x[2] < x[3]:
                    todo.append(x)
                    possible += min(x[1] - x[0], x[3] - x[2])
    return total if total >= least else -1


def matched(a: str, b: str, least: int = 0) -> int:
    """Characters in the matching blocks of two texts; -1 once it is known that there are fewer than ``least``."""
    if a == b:
        return len(a)
    if len(a) * len(b) > CELLS:
        return _matched_long(a, b, least)
    grid, total, possible = Grid(a, b), 0, min(len(a), len(b))
    todo = [(0, len(a), 0, len(b))] if possible else []
    while todo:
        if possible < least:
            return -1
        alo, ahi, blo, bhi = todo.pop()
        possible -= min(ahi - alo, bhi - blo)
        i, j, n = grid.longest(alo, ahi, blo, bhi)
        if n:
            total += n
            possible += n
            for x in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)):
                if x[0] < x[1] and x[2] < x[3]:
                    todo.append(x)
                    possible += min(x[1] - x[0], x[3] - x[2])
    return total if total >= least else -1
