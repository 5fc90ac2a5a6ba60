"""External induced suffix sorting with common prefixes.

Suffixes are sorted by induction from the leftmost-S suffixes: one ascending pass over a priority queue yields the
L-suffixes, one descending pass the S-suffixes.  A queue entry is a suffix tuple (first symbol, arrival, position) with
the common-prefix value it shares with the entry before it; the value follows from those of the successors,
1 + min over the successors scanned since the last entry of that symbol.  Leftmost-S substrings are sorted by the same
two passes, named, and the string of names is sorted by recursion until it fits the memory budget.

The budget is a number of entries.  The queue holds that many; what is more goes to disk in runs, which come back piece by
piece when their symbol is the least.  Every array of the length of the text (the text, the leftmost-S positions, the
names, the suffix array and its common prefixes) is a memory-mapped file as soon as it exceeds the budget, and is read
and written in chunks of a sixteenth of the budget.  So the sort's own memory follows the budget and the alphabet, not the
text.  The recursion sorts names with a second form of the queue, whose entries are dealt to ranges of names that fit the
budget.  Common prefixes start from a direct comparison of neighbouring leftmost-S suffixes, up to the cap.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Longest common prefix that is told apart.
CAP = 250
_NONE = 1 << 20


class Space:
    """Arrays within a budget: larger ones are files of a work folder."""

    def __init__(self, memory: int, folder: str | None):
        self.memory, self.folder = memory, folder
        self.chunk = max(256, memory // 16)

    def array(self, n: int, kind: type | np.dtype) -> np.ndarray:
        """n zeros."""
        if self.folder is None or n <= self.memory:
            return np.zeros(n, kind)
        with tempfile.TemporaryFile(dir=self.folder) as handle:
            return np.memmap(handle, kind, "w+", shape=(n,)).view(np.ndarray)  # the mapping outlives the handle

    def chunks(self, first: int, last: int) -> Iterator[tuple[int, int]]:
        for i in range(first, last, self.chunk):
            yield i, min(i + self.chunk, last)

    def text(self, symbols: np.ndarray) -> np.ndarray:
        """A copy of a text with 16 zeros behind it, for ``eights``."""
        out = self.array(len(symbols) + 16, symbols.dtype)
        for i, j in self.chunks(0, len(symbols)):
            out[i:j] = symbols[i:j]
        return out[: len(symbols)]


class SuffixQueue:
    """A disk-backed priority queue of suffix tuples; those of the least symbol leave together, in arrival order."""

    def __init__(self, space: Space, descending: bool = False):
        self.space, self.sign = space, -1 if descending else 1
        self.ram: dict[int, list] = defaultdict(list)
        self.runs: dict[int, list] = defaultdict(list)
        self.heap: list[int] = []
        self.known: set[int] = set()
        self.held = self.spilled = 0
        self.file = None

    def touch(self, symbol: int) -> None:
        if symbol not in self.known:
            self.known.add(symbol)
            heapq.heappush(self.heap, self.sign * symbol)

    def push(self, symbol: int, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        self.touch(symbol)
        self.ram[symbol].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.space.memory and self.space.folder:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.space.folder)
        self.file.seek(0, os.SEEK_END)
        self.spilled += self.held
        for symbol, parts in self.ram.items():
            for i in range(0, len(parts), 64):
                pos, lcp = _joined(parts[i : i + 64])
                self.runs[symbol].append((self.file.tell(), len(pos), pos.dtype, None if lcp is None else lcp.dtype))
                self.file.write(pos.tobytes())
                if lcp is not None:
                    self.file.write(lcp.tobytes())
        self.ram.clear()
        self.held = 0

    def least(self) -> int | None:
        """The next symbol to visit; each symbol is visited once."""
        return self.sign * heapq.heappop(self.heap) if self.heap else None

    def take(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """The tuples of a symbol in order, those that arrive meanwhile too."""
        while True:
            if runs := self.runs.pop(symbol, None):
                for at, n, kind, lcp_kind in runs:
                    for i, j in self.space.chunks(0, n):
                        self.file.seek(at + i * kind.itemsize)
                        pos = np.frombuffer(self.file.read((j - i) * kind.itemsize), kind)
                        if lcp_kind is not None:
                            self.file.seek(at + n * kind.itemsize + i * lcp_kind.itemsize)
                        yield pos, None if lcp_kind is None else np.frombuffer(self.file.read((j - i) * lcp_kind.itemsize), lcp_kind)
            elif parts := self.ram.pop(symbol, None):
                self.held -= sum(len(p) for p, _ in parts)
                pos, lcp = _joined(parts)
                for i, j in self.space.chunks(0, len(pos)):
                    yield pos[i:j], None if lcp is None else lcp[i:j]
            else:
                return

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray | None]:
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([p for p, _ in parts]), None if parts[0][1] is None else np.concatenate([x for _, x in parts])


def eights(text: np.ndarray) -> np.ndarray | None:
    """Eight symbols at each position as an integer, where a symbol fits a byte: a view of a padded text."""
    if text.dtype != np.uint8:
        return None
    return np.lib.stride_tricks.as_strided(text[:1].view(np.uint8), (len(text) + 16 - 8 + 1, 8), (1, 1)).view("<u8")[:, 0]


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int = CAP, wide: np.ndarray | None = None) -> np.ndarray:
    """Common prefix lengths of the suffixes at a and b, up to ``cap``; ``wide``: the text's eights."""
    n, out = len(text), np.zeros(len(a), np.int16)
    live = np.arange(len(a))
    if wide is not None:
        most = np.minimum(n - np.maximum(a, b), cap).astype(np.int16)
        for j in range(0, cap, 8):
            x = wide[np.minimum(a[live] + j, n)] ^ wide[np.minimum(b[live] + j, n)]
            below = (x & (~x + np.uint64(1))) - np.uint64(1)  # ones up to the first bit that differs, all if none does
            same = (np.bitwise_count(below) >> 3).astype(np.int16)
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
            if not len(live):
                break
        return np.minimum(out, most)
    for j in range(cap):
        x, y = a[live] + j, b[live] + j
        inside = np.maximum(x, y) < n
        live = live[inside]
        live = live[text[x[inside]] == text[y[inside]]]
        if not len(live):
            break
        out[live] += 1
    return out


def _kind(n: int) -> type:
    return np.int32 if n < 1 << 31 else np.int64


def _leftmost(text: np.ndarray, space: Space) -> np.ndarray:
    """Positions of the suffixes that are smaller than their successor while the one before is not, ascending."""
    n = len(text)
    out = space.array(n // 2 + 1, _kind(n))
    at, later = len(out), False  # the last suffix is no S-suffix: the end is less than any symbol
    for i, j in reversed(list(space.chunks(0, n))):
        here = text[i : min(j + 1, n)].astype(np.int64)
        step = np.sign(np.diff(here)) if j < n else np.r_[np.sign(np.diff(here)), -1]
        where = np.where(step != 0, np.arange(j - i), j - i)
        where = np.minimum.accumulate(where[::-1])[::-1]
        s = np.where(where < j - i, step[np.minimum(where, j - i - 1)] > 0, later)
        before = text[i - 1 : j - 1] if i else np.r_[text[:1], text[: j - 1]]
        found = np.flatnonzero(s & (before > here[: j - i])) + i
        out[at - len(found) : at] = found
        at, later = at - len(found), bool(s[0])
    return out[at:]


class _Pass:
    """One induction pass."""

    def __init__(self, text: np.ndarray, space: Space, descending: bool, with_lcp: bool, sigma: int, cap: int):
        self.text, self.down, self.cap = text, descending, cap
        self.queue = SuffixQueue(space, descending)
        self.carry = np.full(sigma, _NONE, np.int32) if with_lcp else None
        self.begun = np.zeros(sigma, bool) if with_lcp else None

    def induce(self, symbol: int, pos: np.ndarray, lcp: np.ndarray | None, same: bool) -> None:
        """Push the predecessors of scanned suffixes that begin with ``symbol``; ``same``: also those with that symbol."""
        before = self.text[pos - 1]
        if self.down:
            fit = (before <= symbol) if same else (before < symbol)
        else:
            fit = (before >= symbol) if same else (before > symbol)
        chosen = np.flatnonzero(fit & (pos > 0))
        to = before[chosen]
        order = np.argsort(to, kind="stable")
        chosen, to = chosen[order], to[order]
        cuts = np.r_[0, np.flatnonzero(to[1:] != to[:-1]) + 1, len(to)] if len(to) else np.zeros(1, np.int64)
        if self.carry is not None:
            old = self.carry.copy()
            np.minimum(self.carry, int(lcp.min()), out=self.carry)
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at, t = chosen[i:j], int(to[i])
            value = None
            if self.carry is not None:
                last = int(at[-1])
                since = np.zeros(j - i, np.int64)
                since[1:] = at[:-1] + 1
                value = np.minimum.reduceat(lcp[: last + 1], since)
                value[0] = min(int(value[0]), int(old[t])) if self.begun[t] else -1
                value = np.minimum(value + 1, self.cap).astype(np.int16)
                self.begun[t] = True
                self.carry[t] = int(lcp[last + 1 :].min()) if last + 1 < len(lcp) else _NONE
            self.queue.push(t, pos[at] - 1, value)


def _one(text: np.ndarray, a: int, b: int, cap: int) -> int:
    return int(common(text, np.array([a]), np.array([b]), cap)[0])


def _induce(text: np.ndarray, lms: np.ndarray, lms_lcp: np.ndarray | None, space: Space, sigma: int, cap: int = CAP):
    """The suffixes, their common prefixes, and the first S-suffix of each symbol, induced from leftmost-S suffixes in order.

    A symbol's suffixes have their place from the start: L-suffixes are written from its head, S-suffixes from its tail.
    """
    with_lcp, n, kind = lms_lcp is not None, len(text), lms.dtype
    count, heads = np.zeros(sigma, np.int64), np.zeros(sigma, np.int64)
    for i, j in space.chunks(0, n):
        count += np.bincount(text[i:j], minlength=sigma)
    for i, j in space.chunks(0, len(lms)):
        heads += np.bincount(text[lms[i:j]], minlength=sigma)
    end, lms_end = np.cumsum(count), np.cumsum(heads)
    order, shared = space.array(n, kind), space.array(n if with_lcp else 0, np.int16)
    up = _Pass(text, space, False, with_lcp, sigma, cap)
    final = int(text[n - 1])
    if with_lcp:
        up.begun[final] = True
    up.queue.push(final, np.array([n - 1], kind), np.zeros(1, np.int16) if with_lcp else None)
    for symbol in np.flatnonzero(heads).tolist():
        up.queue.touch(symbol)
    middle = end.copy()  # where the L-suffixes of a symbol end
    while (c := up.queue.least()) is not None:
        head = first = int(end[c] - count[c])
        for pos, lcp in up.queue.take(c):
            order[head : head + len(pos)] = pos
            if with_lcp:
                shared[head : head + len(pos)] = lcp
            head += len(pos)
            up.induce(c, pos, lcp, same=True)
        middle[c] = head
        for i, j in space.chunks(int(lms_end[c] - heads[c]), int(lms_end[c])):
            lcp = None
            if with_lcp:
                lcp = np.array(lms_lcp[i:j])
                if i == lms_end[c] - heads[c]:
                    lcp[0] = _one(text, int(order[head - 1]), int(lms[i]), cap) if head > first else 0
            up.induce(c, np.asarray(lms[i:j]), lcp, same=False)
    up.queue.close()
    down = _Pass(text, space, True, with_lcp, sigma, cap)
    for symbol in np.flatnonzero(middle > end - count).tolist():
        down.queue.touch(symbol)
    while (c := down.queue.least()) is not None:
        last, first = int(end[c]), int(end[c] - count[c])
        tail, stop = last, int(middle[c]) if count[c] else last
        for pos, lcp in down.queue.take(c):
            k = len(pos)
            order[tail - k : tail] = pos[::-1]
            if with_lcp:  # a value belongs to the entry written before, which is the larger one
                high = min(tail + 1, last)
                shared[tail - k + 1 : high] = lcp[::-1][: high - tail + k - 1]
            tail -= k
            down.induce(c, pos, lcp, same=True)
        stop = min(stop, tail)
        seam = _one(text, int(order[stop - 1]), int(order[tail]), cap) if with_lcp and first < stop and tail < last else 0
        if with_lcp and tail < last:
            shared[tail] = seam
        for i, j in reversed(list(space.chunks(first, stop))):
            lcp = None
            if with_lcp:
                lcp = np.r_[shared[j] if j < stop else np.int16(seam), shared[i + 1 : j][::-1]].astype(np.int16)
            down.induce(c, np.array(order[i:j][::-1]), lcp, same=False)
        middle[c] = tail
    down.queue.close()
    return order, shared, middle, end


def _sorted_small(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string that fits memory: prefixes doubled in length, only unsettled groups sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    head = np.r_[True, names[order[1:]] != names[order[:-1]]]
    rank = np.empty(n, np.int64)  # of a group: the place of its first member
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[order] = place
    k = 1
    while True:
        tied = ~head | ~np.r_[head[1:], True]
        at = np.flatnonzero(tied)
        if not len(at):
            return order
        who = order[at]
        after = who + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = place[at] * (n + 2) + second
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[at] = who
        first = np.r_[True, key[1:] != key[:-1]]
        head[at] = first
        place[at] = np.maximum.accumulate(np.where(first, at, 0))
        rank[who] = place[at]
        k *= 2


def _by_head(text: np.ndarray, lms: np.ndarray, space: Space, sigma: int) -> np.ndarray:
    """Leftmost-S positions by their first symbol."""
    if len(lms) <= space.memory:
        return lms[np.argsort(text[lms], kind="stable")]
    queue = SuffixQueue(space)
    for i, j in space.chunks(0, len(lms)):
        pos = np.asarray(lms[i:j])
        to = text[pos]
        order = np.argsort(to, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            queue.push(int(to[part[0]]), pos[part], None)
    out, at = space.array(len(lms), lms.dtype), 0
    while (c := queue.least()) is not None:
        for pos, _ in queue.take(c):
            out[at : at + len(pos)] = pos
            at += len(pos)
    queue.close()
    return out


def _lms_order(text: np.ndarray, lms: np.ndarray, space: Space, sigma: int, wide: np.ndarray | None) -> np.ndarray:
    """Leftmost-S positions in the order of their suffixes."""
    n, m = len(text), len(lms)
    if m < 2:
        return lms
    order, _, tail, end = _induce(text, _by_head(text, lms, space, sigma), None, space, sigma)
    ranked, at = space.array(m, lms.dtype), 0
    for c in range(sigma):
        for i, j in space.chunks(int(tail[c]), int(end[c])):
            pos = np.asarray(order[i:j])
            pos = pos[(pos > 0) & (text[pos - 1] > c)]
            ranked[at : at + len(pos)] = pos
            at += len(pos)
    del order
    # names: adjacent substrings are equal if they have equal symbols up to and with the next leftmost-S position
    names, name, last = space.array(m, np.int64), -1, None
    index = None  # of each position in lms, where that fits the budget
    if n <= space.memory:
        index = np.empty(n, lms.dtype)
        index[lms] = np.arange(m, dtype=lms.dtype)
    for i, j in space.chunks(0, m):
        pos = np.asarray(ranked[i:j]) if last is None else np.r_[last[0], ranked[i:j]]
        of = np.searchsorted(lms, pos) if index is None else index[pos]
        after = np.where(of + 1 < m, lms[np.minimum(of + 1, m - 1)], n)
        length = after - pos
        a, b = pos[:-1], pos[1:]
        same = (length[:-1] == length[1:]) & (after[:-1] < n) & (after[1:] < n)
        live = np.flatnonzero(same)
        if wide is not None:
            same[live] = common(text, a[live], b[live], int(length.max(initial=0)) + 1, wide) > length[1:][live]
        else:
            same[:] = False
            k = 0
            while len(live):
                live = live[text[a[live] + k] == text[b[live] + k]]
                done = length[1:][live] == k
                same[live[done]] = True
                live = live[~done]
                k += 1
        rank = name + np.cumsum(~same) if last is not None else name + np.cumsum(np.r_[True, ~same])
        names[of if last is None else of[1:]] = rank
        name, last = int(rank[-1]), pos[-1:]
    if name == m - 1:
        return ranked
    del ranked
    found = _sorted_small(names) if m <= space.memory or space.folder is None else name_order(names, space, name + 1)
    out = space.array(m, lms.dtype)
    for i, j in space.chunks(0, m):
        out[i:j] = lms[found[i:j]]
    return out


class NameQueue:
    """A disk-backed priority queue of (name, position) over many names: ranges of names that fit the budget each have a
    run on disk, and the range at hand is a heap."""

    def __init__(self, space: Space, end: np.ndarray, descending: bool):
        self.sign, self.arrival = -1 if descending else 1, 0
        self.file, self.space = tempfile.TemporaryFile(dir=space.folder), space
        marks, low = [0], 0
        while low < len(end):
            least = int(end[low - 1]) if low else 0
            low = max(low + 1, int(np.searchsorted(end, least + max(256, space.memory // 16), "right")))
            marks.append(min(low, len(end)))
        self.marks = marks
        self.buffer: dict[int, list] = defaultdict(list)
        self.runs: dict[int, list] = defaultdict(list)
        self.held, self.at, self.heap = 0, -1, []

    def ranges(self) -> Iterator[tuple[int, int]]:
        """The ranges of names one after another; the heap holds what has come for the range."""
        for k in range(len(self.marks) - 1) if self.sign > 0 else range(len(self.marks) - 2, -1, -1):
            self.at = k
            for where, n in self.runs.pop(k, ()):
                self.file.seek(where)
                for name, pos in np.frombuffer(self.file.read(16 * n), np.int64).reshape(-1, 2).tolist():
                    self._enter(name, pos)
            mine = self.buffer.pop(k, [])
            self.held -= len(mine)
            for name, pos in mine:
                self._enter(name, pos)
            yield self.marks[k], self.marks[k + 1]

    def _enter(self, name: int, pos: int) -> None:
        heapq.heappush(self.heap, (self.sign * name, self.arrival, pos))
        self.arrival += 1

    def push(self, name: int, pos: int) -> None:
        if self.marks[self.at] <= name < self.marks[self.at + 1]:
            return self._enter(name, pos)
        self.buffer[int(np.searchsorted(self.marks, name, "right")) - 1].append((name, pos))
        self.held += 1
        if self.held > self.space.memory // 16:
            self.file.seek(0, os.SEEK_END)
            for k, rows in self.buffer.items():
                self.runs[k].append((self.file.tell(), len(rows)))
                self.file.write(np.array(rows, np.int64).tobytes())
            self.buffer.clear()
            self.held = 0

    def least(self) -> int | None:
        return self.sign * self.heap[0][0] if self.heap else None

    def pop(self) -> int:
        return heapq.heappop(self.heap)[2]


def name_order(text: np.ndarray, space: Space, sigma: int) -> np.ndarray:
    """The suffix array of a text of names 0 .. sigma - 1, each of which occurs, by recursion."""
    lms, n = _leftmost(text, space), len(text)
    end = space.array(sigma, np.int64)
    for i, j in space.chunks(0, n):
        np.add.at(end, text[i:j], 1)
    total = 0
    for i, j in space.chunks(0, sigma):
        end[i:j] = total + np.cumsum(end[i:j])
        total = int(end[j - 1])
    ranked = lms
    if len(lms) > 1:
        order, tail = _induce_names(text, _names_by_head(text, lms, space, end), space, end)
        ranked = _name_ranks(text, lms, order, tail, space, end)
    return _induce_names(text, ranked, space, end)[0]


def _names_by_head(text: np.ndarray, lms: np.ndarray, space: Space, end: np.ndarray) -> np.ndarray:
    out, at, queue = space.array(len(lms), lms.dtype), 0, NameQueue(space, end, False)
    for i, j in space.chunks(0, len(lms)):
        for name, pos in zip(text[lms[i:j]].tolist(), lms[i:j].tolist(), strict=True):
            queue.push(name, pos)
    for _ in queue.ranges():
        mine = [queue.pop() for _ in range(len(queue.heap))]
        out[at : at + len(mine)] = mine
        at += len(mine)
    return out


def _name_ranks(text: np.ndarray, lms: np.ndarray, order: np.ndarray, tail: np.ndarray, space: Space, end: np.ndarray) -> np.ndarray:
    """Leftmost-S positions in the order of their suffixes, from the order of their substrings."""
    n, m = len(text), len(lms)
    ranked, at = space.array(m, lms.dtype), 0
    for i, j in space.chunks(0, n):
        pos = np.asarray(order[i:j])
        name = text[pos]
        pos = pos[(np.arange(i, j) >= tail[name]) & (pos > 0) & (text[pos - 1] > name)]
        ranked[at : at + len(pos)] = pos
        at += len(pos)
    names, name, last = space.array(m, np.int64), -1, None
    for i, j in space.chunks(0, m):
        of = np.searchsorted(lms, ranked[i:j])
        ranks = []
        for pos, k in zip(ranked[i:j].tolist(), of.tolist(), strict=True):
            stop = int(lms[k + 1]) if k + 1 < m else n
            same = last is not None and stop < n and last[1] < n and stop - pos == last[1] - last[0] and bool((text[pos : stop + 1] == text[last[0] : last[1] + 1]).all())
            name, last = name + (not same), (pos, stop)
            ranks.append(name)
        names[of] = ranks
    if name == m - 1:
        return ranked
    found = _sorted_small(names) if m <= space.memory else name_order(names, space, name + 1)
    for i, j in space.chunks(0, m):
        ranked[i:j] = lms[found[i:j]]
    return ranked


def _induce_names(text: np.ndarray, lms: np.ndarray, space: Space, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a text of names, induced from its leftmost-S suffixes, and where the S-suffixes of each name begin."""
    n, order, sigma = len(text), space.array(len(text), lms.dtype), len(end)
    middle, tail = space.array(sigma, np.int64), space.array(sigma, np.int64)
    seeds = ((int(text[p]), p) for i, j in space.chunks(0, len(lms)) for p in lms[i:j].tolist())
    seed, queue = next(seeds, None), NameQueue(space, end, False)
    queue.push(int(text[n - 1]), n - 1)
    for low, high in queue.ranges():
        for c in range(low, high):
            head = int(end[c - 1]) if c else 0
            while queue.least() == c:
                pos = queue.pop()
                order[head] = pos
                head += 1
                if pos and text[pos - 1] >= c:
                    queue.push(int(text[pos - 1]), pos - 1)
            middle[c] = head
            while seed is not None and seed[0] == c:
                if seed[1] and text[seed[1] - 1] > c:
                    queue.push(int(text[seed[1] - 1]), seed[1] - 1)
                seed = next(seeds, None)
    queue = NameQueue(space, end, True)
    for low, high in queue.ranges():
        for c in range(high - 1, low - 1, -1):
            at = int(end[c])
            while queue.least() == c:
                pos = queue.pop()
                at -= 1
                order[at] = pos
                if pos and text[pos - 1] <= c:
                    queue.push(int(text[pos - 1]), pos - 1)
            tail[c] = at
            for i, j in reversed(list(space.chunks(int(end[c - 1]) if c else 0, int(middle[c])))):
                for pos in order[i:j][::-1].tolist():
                    if pos and text[pos - 1] < c:
                        queue.push(int(text[pos - 1]), pos - 1)
    return order, tail


def suffix_sort(text: np.ndarray, memory: int = 1 << 26, folder: str | None = None, cap: int = CAP) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefix with the suffix before, up to ``cap``) of a text of small non-negative integers."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    sigma, space = int(text.max()) + 1, Space(memory, folder)
    text = space.text(text)
    wide, lms = eights(text), _leftmost(text, space)
    lms = _lms_order(text, lms, space, sigma, wide)
    lcp = space.array(len(lms), np.int16)
    for i, j in space.chunks(1, len(lms)):
        lcp[i:j] = common(text, np.asarray(lms[i - 1 : j - 1]), np.asarray(lms[i:j]), cap, wide)
    return _induce(text, lms, lcp, space, sigma, cap)[:2]
