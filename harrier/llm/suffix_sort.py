"""External induced suffix sorting with common prefixes.

Suffixes are L (larger than the next) or S. Those S suffixes that follow an L suffix (the starts) are sorted first:
an induction from them in any order sorts the stretches between them, their names make a shorter string,
and that is sorted in the same way, recursively. The order of all others is induced:
a scan upwards through the buckets of first symbols sends each suffix's L predecessor to its
own bucket, a scan downwards does so for S. Within a bucket suffixes arrive in their order, so a
bucket's priority queue is a queue, and its entries are tuples (suffix, length of the common prefix
with the one before). A common prefix is induced too: it is one more than the least common
prefix between the two inducing suffixes.

``memory`` bounds what is held, in suffixes. Queues write their tuples to disk beyond it and hand them back in parts; text,
types, suffixes and common prefixes of a longer string are files that are mapped, and are read and written in
stretches. A string of no more than ``memory`` starts names and sorts them in memory, which ends the recursion.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np


class Arrays:
    """Arrays in memory, or in mapped files if they are longer than ``memory``."""

    def __init__(self, memory: int):
        self.memory, self.files = memory, 0

    def zeros(self, n: int, dtype) -> np.ndarray:
        if n <= self.memory:
            return np.zeros(n, dtype)
        self.files += 1
        with tempfile.TemporaryFile() as f:  # the map keeps the file
            f.truncate(n * np.dtype(dtype).itemsize)
            return np.memmap(f, dtype, "r+", shape=(n,))

    def stretches(self, n: int):
        step = max(self.memory, 1)
        return [(lo, min(lo + step, n)) for lo in range(0, n, step)]


class BucketQueues:
    """A queue of (suffix, common prefix) tuples for each symbol; on disk beyond ``limit`` tuples."""

    def __init__(self, limit: int):
        self.limit, self.held, self.parts, self.file, self.spills = limit, 0, {}, None, 0

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.parts.setdefault(symbol, deque()).append((at, lcp))
        self.held += len(at)
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        self.spills += 1
        for parts in self.parts.values():
            for i, part in enumerate(parts):
                if not isinstance(part[0], int):
                    parts[i] = (self.file.tell(), len(part[0]))
                    self.file.write(part[0].astype(np.int64).tobytes() + part[1].astype(np.uint8).tobytes())
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The oldest tuples of a symbol's queue, as many parts as are within the limit, one at least; none if it is empty."""
        parts = self.parts.get(symbol)
        if not parts:
            return None
        out, n = [], 0
        while parts and (not out or n + self._size(parts[0]) <= self.limit):
            a, b = parts.popleft()
            if isinstance(a, int):
                self.file.seek(a)
                raw = self.file.read(9 * b)
                a, b = np.frombuffer(raw, np.int64, b), np.frombuffer(raw, np.uint8, b, 8 * b)
            else:
                self.held -= len(a)
            out.append((a, b))
            n += len(a)
        return out[0] if len(out) == 1 else (np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]))

    @staticmethod
    def _size(part: tuple) -> int:
        return part[1] if isinstance(part[0], int) else len(part[0])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class _Induction:
    """The common prefixes that a scan's tuples hand to the buckets that it sends to."""

    def __init__(self, symbols: int, cap: int):
        self.cap, self.least, self.begun = cap, np.zeros(symbols, np.uint8), np.zeros(symbols, bool)

    def send(self, lcp: np.ndarray, to: np.ndarray, chosen: np.ndarray):
        """``lcp``: of scanned suffixes with the one scanned before; ``chosen`` of them send to the symbols ``to``.
        Yields (symbol, indices into chosen, common prefixes of what is sent)."""
        if not len(lcp):
            return
        levels, w = [lcp], 1
        while 2 * w <= len(lcp):
            levels.append(np.minimum(levels[-1][:-w], levels[-1][w:]))
            w *= 2

        def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:  # over lo..hi, both included
            out = np.empty(len(lo), np.uint8)
            k = np.frexp((hi - lo + 1).astype(float))[1] - 1
            for j in np.unique(k):
                s = np.flatnonzero(k == j)
                out[s] = np.minimum(levels[j][lo[s]], levels[j][hi[s] + 1 - (1 << j)])
            return out

        untouched = np.ones(len(self.least), bool)
        if len(chosen):
            order = np.argsort(to.astype(np.uint16) if len(self.least) < 65536 else to, kind="stable")
            t, at = to[order], chosen[order]
            head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            tail = np.append(head[1:], len(t))
            lo = np.concatenate([[0], at[:-1] + 1])
            lo[head] = 0
            got = least(lo, at)
            got[head] = np.minimum(got[head], self.least[t[head]])
            got = np.minimum(got, self.cap - 1) + np.uint8(1)
            got[head[~self.begun[t[head]]]] = 0
            self.begun[t[head]] = True
            for h, e in zip(head.tolist(), tail.tolist(), strict=True):
                yield int(t[h]), order[h:e], got[h:e]
            last = at[tail - 1]
            rest = last + 1 < len(lcp)
            self.least[t[head]] = self.cap
            if rest.any():
                self.least[t[head][rest]] = least(last[rest] + 1, np.full(int(rest.sum()), len(lcp) - 1))
            untouched[t[head]] = False
        self.least[untouched] = np.minimum(self.least[untouched], lcp.min())


def _common(words: np.ndarray, bits: int, per: int, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, up to cap; ``words``: the next ``per`` symbols in ``bits`` each."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        differ = words[np.minimum(i, len(words) - 1)] ^ words[np.minimum(j, len(words) - 1)]
        out[live] += per - -(-np.frexp(differ.astype(float))[1] // bits)  # symbols before the highest bit that differs
        live = live[(differ == 0) & (out[live] < cap)]
    return np.minimum(out, cap).astype(np.uint8)


def _sorted_in_memory(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffixes at ``lms`` in order: name the stretches, then sort the string of names by doubling."""
    symbol = text.astype(np.int64) * 2 + s_type
    lens = np.append(np.diff(lms) + 1, 1)
    bits = int(symbol.max()).bit_length()
    per = max(1, 62 // bits)
    order, group, depth = np.arange(len(lms)), np.zeros(len(lms), np.int64), 0
    live = np.arange(len(lms))
    while len(live):  # stretches that are equal so far, by their next symbols
        word = np.zeros(len(live), np.int64)
        for k in range(depth, depth + per):
            inside = k < lens[live]
            word = (word << bits) | np.where(inside, symbol[np.minimum(lms[live] + k, len(text) - 1)], 0)
        at = np.lexsort((word, group[live]))
        live, word = live[at], word[at]
        g = group[live]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (word[1:] != word[:-1])])
        # a group's first keeps its place; parts of it move on by their position in it
        start = np.concatenate([[True], g[1:] != g[:-1]])
        base = np.maximum.accumulate(np.where(start, np.arange(len(live)), 0))
        group[live] = g + np.maximum.accumulate(np.where(new, np.arange(len(live)), 0)) - base
        depth += per
        size = np.diff(np.append(np.flatnonzero(new), len(live)))
        live = live[(np.repeat(size, size) > 1) & (lens[live] > depth)]
    name = group
    # sort the string of names by pairs of names at doubling distances
    w = 1
    while True:
        order = np.argsort(name, kind="stable")
        r = name[order]
        tied = np.flatnonzero(np.concatenate([r[1:] == r[:-1], [False]]) | np.concatenate([[False], r[1:] == r[:-1]]))
        if not len(tied):
            return lms[order]
        who = order[tied]
        nxt = np.where(who + w < len(name), name[np.minimum(who + w, len(name) - 1)] + 1, 0)
        at = np.lexsort((nxt, name[who]))
        who, nxt = who[at], nxt[at]
        g = name[who]
        start = np.concatenate([[True], g[1:] != g[:-1]])
        new = start | np.concatenate([[True], nxt[1:] != nxt[:-1]])
        base = np.maximum.accumulate(np.where(start, np.arange(len(who)), 0))
        name = name.copy()
        name[who] = g + np.maximum.accumulate(np.where(new, np.arange(len(who)), 0)) - base
        w *= 2


class _Text:
    """A string with its end, the types of its suffixes, runs of equal symbols, and its buckets."""

    def __init__(self, text: np.ndarray, cap: int, arrays: Arrays):
        n = len(text) + 1
        self.n, self.arrays = n, arrays
        self.t = arrays.zeros(n, np.int32)
        top = 0
        for lo, hi in arrays.stretches(n - 1):
            self.t[lo:hi] = text[lo:hi]
            self.t[lo:hi] += 1  # the end is smallest
            top = max(top, int(self.t[lo:hi].max()))
        self.symbols = top + 1
        self.s_type, self.run = arrays.zeros(n, bool), arrays.zeros(n, np.uint8)
        self.s_type[n - 1], self.run[n - 1] = True, 1
        self.large, self.all = np.zeros(self.symbols, np.int64), np.zeros(self.symbols, np.int64)
        self.all[0] = 1
        for lo, hi in reversed(arrays.stretches(n - 1)):
            x, y = np.asarray(self.t[lo:hi]), np.asarray(self.t[lo + 1 : hi + 1])
            m = hi - lo
            last = np.minimum.accumulate(np.where(x != y, np.arange(m), m)[::-1])[::-1]  # where the run of equal symbols ends
            inside = np.minimum(last, m - 1)
            self.s_type[lo:hi] = s = np.where(last < m, x[inside] < y[inside], self.s_type[hi])
            self.run[lo:hi] = np.minimum(np.where(last < m, last - np.arange(m) + 1, m - np.arange(m) + int(self.run[hi])), cap)
            self.all += np.bincount(x, minlength=self.symbols)
            self.large += np.bincount(x[~s], minlength=self.symbols)
        self.begin = np.concatenate([[0], np.cumsum(self.all)])

    def starts(self) -> np.ndarray:
        found = [np.flatnonzero(np.asarray(self.s_type[lo + 1 : hi + 1]) & ~np.asarray(self.s_type[lo:hi])) + lo + 1 for lo, hi in self.arrays.stretches(self.n - 1)]
        out = self.arrays.zeros(sum(map(len, found)), np.int64)
        np.concatenate(found, out=out) if found else None
        return out

    def by_symbol(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``at`` dealt to the buckets in the order that it has, and where each bucket begins."""
        sizes = np.zeros(self.symbols, np.int64)
        for lo, hi in self.arrays.stretches(len(at)):
            sizes += np.bincount(self.t[at[lo:hi]], minlength=self.symbols)
        edge = np.concatenate([[0], np.cumsum(sizes)])
        out, place = self.arrays.zeros(len(at), np.int64), edge[:-1].copy()
        for lo, hi in self.arrays.stretches(len(at)):
            some = np.asarray(at[lo:hi])
            symbol = self.t[some]
            order = np.argsort(symbol, kind="stable")
            s = symbol[order]
            first = np.searchsorted(s, s)
            out[place[s] + np.arange(len(s)) - first] = some[order]
            place += np.bincount(symbol, minlength=self.symbols)
        return out, edge

    def induce(self, starts: np.ndarray, edge: np.ndarray, first_lcp: np.ndarray | None, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes and common prefixes from the starts, which lie in the order of their buckets."""
        n, t, s_type, run, begin, step = self.n, self.t, self.s_type, self.run, self.begin, max(self.arrays.memory, 1)
        sa, lcps = self.arrays.zeros(n, np.int64), self.arrays.zeros(n + 1, np.uint8)
        queues = BucketQueues(self.arrays.memory)

        def scan(kind: bool, induction: _Induction, at: np.ndarray, lcp: np.ndarray) -> None:
            """Send the predecessors of type ``kind`` of scanned suffixes."""
            ok = np.flatnonzero(at > 0)
            ok = ok[s_type[at[ok] - 1] == kind]
            pred = at[ok] - 1
            for symbol, idx, got in induction.send(lcp, t[pred], ok):
                queues.push(symbol, pred[idx], got)

        up = _Induction(self.symbols, cap)
        for c in range(self.symbols):
            pos = begin[c]
            while (part := queues.pop(c)) is not None:
                at, lcp = part
                sa[pos : pos + len(at)], lcps[pos : pos + len(at)] = at, lcp
                pos += len(at)
                scan(False, up, at, lcp)
            for lo in range(edge[c], edge[c + 1], step):
                mine = np.asarray(starts[lo : min(lo + step, edge[c + 1])])
                lcp = np.zeros(len(mine), np.uint8) if first_lcp is None else np.array(first_lcp[lo : lo + len(mine)])
                if lo == edge[c]:
                    lcp[0] = min(run[sa[pos - 1]], run[mine[0]]) if pos > begin[c] else 0
                scan(False, up, mine, lcp)
        down = _Induction(self.symbols, cap)
        # in the downward scan a tuple's common prefix is with the next larger suffix
        queues.push(0, np.array([n - 1]), np.zeros(1, np.uint8))
        for c in range(self.symbols - 1, -1, -1):
            pos, large = begin[c + 1], begin[c] + self.large[c]
            while (part := queues.pop(c)) is not None:
                at, lcp = part
                lo = pos - len(at)
                sa[lo:pos], lcps[lo + 1 : pos + 1] = at[::-1], lcp[::-1]
                pos = lo
                scan(True, down, at, lcp)
            edge_lcp = 0
            if pos < begin[c + 1]:
                edge_lcp = min(run[sa[large - 1]], run[sa[pos]]) if large > begin[c] else 0
                lcps[pos] = edge_lcp
            for hi in range(large, begin[c], -step):
                lo = max(begin[c], hi - step)
                with_next = np.append(lcps[lo + 1 : hi], lcps[hi] if hi < large else edge_lcp)
                scan(True, down, np.asarray(sa[lo:hi])[::-1], with_next[::-1].astype(np.uint8))
            lcps[begin[c]] = 0
        queues.close()
        return sa, lcps

    def equal_stretches(self, a: np.ndarray, b: np.ndarray, end: np.ndarray, end_b: np.ndarray) -> np.ndarray:
        """Whether the stretches a to end and b to end_b, both included, are the same."""
        same = (end - a) == (end_b - b)
        live, depth = np.flatnonzero(same), 0
        while len(live):
            x, y = self.t[a[live] + depth], self.t[b[live] + depth]
            differ = (x != y) | (self.s_type[a[live] + depth] != self.s_type[b[live] + depth])
            same[live[differ]] = False
            live = live[~differ]
            depth += 1
            live = live[a[live] + depth <= end[live]]
        return same

    def common_with_previous(self, starts: np.ndarray, cap: int) -> np.ndarray:
        """Each start's common prefix with the one before. Suffixes differ at the end of the string at the latest."""
        bits = max(1, (self.symbols - 1).bit_length())
        per = max(1, 52 // bits)
        words = self.arrays.zeros(self.n, np.int64)
        for lo, hi in self.arrays.stretches(self.n):
            t = np.asarray(self.t[lo : hi + per]).astype(np.int64)
            t = np.concatenate([t, np.zeros(hi - lo + per - len(t), np.int64)])
            for k in range(per):
                words[lo:hi] <<= bits
                words[lo:hi] |= t[k : hi - lo + k]
        out = self.arrays.zeros(len(starts), np.uint8)
        for lo, hi in self.arrays.stretches(len(starts)):
            here = np.asarray(starts[max(lo - 1, 0) : hi])
            out[hi - len(here) + 1 : hi] = _common(words, bits, per, here[:-1], here[1:], cap)
        return out

    def sorted_starts(self, lms: np.ndarray) -> np.ndarray:
        """The starts in the order of their suffixes."""
        if len(lms) <= self.arrays.memory:
            return _sorted_in_memory(np.asarray(self.t), np.asarray(self.s_type), np.asarray(lms))
        sa, _ = self.induce(*self.by_symbol(lms), None, 1)  # sorts the stretches
        order, k = self.arrays.zeros(len(lms), np.int64), 0  # numbers of the starts, in the order of their stretches
        for lo, hi in self.arrays.stretches(self.n):
            at = np.asarray(sa[lo:hi])
            some = at[(at > 0) & self.s_type[at] & ~self.s_type[at - 1]]
            order[k : k + len(some)] = np.searchsorted(lms, some)
            k += len(some)
        names, name = self.arrays.zeros(len(lms), np.int32), 0
        for lo, hi in self.arrays.stretches(len(lms)):
            here = np.asarray(order[max(lo - 1, 0) : hi])
            end = lambda i: lms[np.minimum(i + 1, len(lms) - 1)]
            new = ~self.equal_stretches(lms[here[:-1]], lms[here[1:]], end(here[:-1]), end(here[1:]))
            new = np.concatenate([[1], new]) if lo == 0 else new
            got = name + np.cumsum(new)
            names[here[len(here) - len(got) :]], name = got - 1, int(got[-1])
        if name == len(lms):
            ranks = order
        else:
            ranks, _ = suffix_array(names, 1, self.arrays.memory)
        out = self.arrays.zeros(len(lms), np.int64)
        for lo, hi in self.arrays.stretches(len(lms)):
            out[lo:hi] = lms[ranks[lo:hi]]
        return out


def suffix_array(text: np.ndarray, cap: int = 200, memory: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and each one's common prefix with the one before, up to ``cap`` (255 at most).

    ``text`` holds non-negative integers. ``memory``: suffixes that are held before they go to disk; longer
    results are mapped files.
    """
    if not len(text):
        return np.empty(0, np.int64), np.empty(0, np.uint8)
    whole = _Text(text, cap, Arrays(memory))
    starts = whole.sorted_starts(whole.starts())
    first_lcp = whole.common_with_previous(starts, cap)
    sizes = np.zeros(whole.symbols, np.int64)
    for lo, hi in whole.arrays.stretches(len(starts)):
        sizes += np.bincount(whole.t[starts[lo:hi]], minlength=whole.symbols)
    sa, lcps = whole.induce(starts, np.concatenate([[0], np.cumsum(sizes)]), first_lcp, cap)  # starts lie in the order of their symbols
    sa, lcps = sa[1:], lcps[1 : len(text) + 1]  # without the end
    lcps[0] = 0
    return sa, lcps
