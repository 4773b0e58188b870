"""Suffix arrays by external induced sorting, with common-prefix values.

The order of the S* suffixes (those that rise after a fall) induces the order of all others: a
sorted suffix, with the character before it, tells where the suffix one longer belongs. Suffix
positions and common-prefix values wait in priority queues, one first-in-first-out run for each
leading character, because the runs fill in sorted order; what exceeds a memory bound is written
to disk and read back when its turn comes. The common prefix of two suffixes that enter a run is
one more than the least value passed between the suffixes that sent them.

The S* suffixes are ordered first: their substrings are sorted by the same induction and named;
where names repeat, pairs of neighbouring names are named again, and so on, until all differ or
cover `depth` characters. Values are capped at 255, which is all that a search for repeats of
`depth` <= 255 characters needs.
"""
from __future__ import annotations

import tempfile

import numpy as np

CAP = 255
BLOCK = 1 << 17  # positions or pairs that a scan holds at once


class RunQueue:
    """256 runs of (position, common prefix) blocks; blocks beyond `memory` bytes wait on disk.

    The spill file is the task's own, unlinked from the start, and never read by another task.
    """

    def __init__(self, memory: int):
        self.memory, self.held = memory, 0
        self.blocks: list[list] = [[] for _ in range(256)]
        self.file = None

    def push(self, char: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks[char].append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        while self.held > self.memory:
            most = max(range(256), key=lambda c: sum(b[0].nbytes for b in self.blocks[c] if len(b) == 2))
            own = self.blocks[most]
            before = self.held
            for i, block in enumerate(own):
                if len(block) == 2:
                    a, b = block
                    if self.file is None:
                        self.file = tempfile.TemporaryFile()
                    self.file.seek(0, 2)
                    own[i] = (self.file.tell(), len(a), a.dtype)
                    self.file.write(a.tobytes() + b.tobytes())
                    self.held -= a.nbytes + b.nbytes
            if self.held == before:
                return

    def take(self, char: int):
        """All blocks of a run in order; the run is empty then, and may be filled again."""
        own, self.blocks[char] = self.blocks[char], []
        for block in own:
            if len(block) == 2:
                self.held -= block[0].nbytes + block[1].nbytes
                yield block
            else:
                where, n, kind = block
                self.file.seek(where)
                yield np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n), np.uint8)


class RangeLeast:
    """Least value of any range, by a table of the least values of ranges of powers of two."""

    def __init__(self, x: np.ndarray):
        rows, k = [x], 1
        while 2 * k <= len(x):
            last = rows[-1]
            row = last.copy()
            row[:len(x) - k] = np.minimum(last[:len(x) - k], last[k:])
            rows.append(row)
            k *= 2
        self.table = np.stack(rows)

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, first], self.table[level, last - (1 << level) + 1])


class Inducer:
    """One pass over the runs. Items come in the order of their suffixes; what they induce is queued."""

    def __init__(self, text: np.ndarray, memory: int):
        self.text, self.queue = text, RunQueue(memory)
        self.least = np.full(256, CAP, np.int64)  # least value since the last item entered a run
        self.filled = np.zeros(256, bool)

    def induce(self, at: np.ndarray, lcp: np.ndarray, wanted) -> None:
        """at, lcp: items in order. wanted: of the characters before them, which ones enter their run."""
        if not len(at):
            return
        char = self.text[at - 1]  # at = 0 is excluded below
        idx = np.flatnonzero((at > 0) & wanted(char))
        if not len(idx):
            self.least = np.minimum(self.least, int(lcp.min()))
            return
        ranges = RangeLeast(lcp)
        order = np.argsort(char[idx], kind="stable")
        idx = idx[order]
        group = char[idx]
        head = np.ones(len(idx), bool)
        head[1:] = group[1:] != group[:-1]
        since = np.zeros(len(idx), np.int64)
        since[1:] = idx[:-1] + 1
        since[head] = 0
        value = np.minimum(ranges(since, idx).astype(np.int64), np.where(head, self.least[group], CAP)) + 1
        value[head & ~self.filled[group]] = 0
        value = np.minimum(value, CAP).astype(np.uint8)
        starts = np.append(np.flatnonzero(head), len(idx))
        self.least = np.minimum(self.least, int(lcp.min()))
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            c = int(group[a])
            self.queue.push(c, at[idx[a:b]] - 1, value[a:b])
            self.filled[c] = True
            last = int(idx[b - 1])
            self.least[c] = int(lcp[last + 1:].min()) if last + 1 < len(lcp) else CAP


def suffix_types(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is S type, length of the run of equal characters from each position). The last suffix falls."""
    n = len(text)
    rises, run = np.zeros(n, bool), np.zeros(n, np.int32)
    end = n - 1  # last position of the run that goes on behind the block
    for lo in range((n - 1) // BLOCK * BLOCK, -1, -BLOCK):
        own = text[lo:lo + BLOCK]
        hi = lo + len(own)
        stops = np.append(own[1:] != own[:-1], hi == n or text[min(hi, n - 1)] != own[-1])
        stop = np.flatnonzero(stops)
        ends = stop + lo
        if not stops[-1]:
            stop, ends = np.append(stop, len(own) - 1), np.append(ends, end)
        ends = np.repeat(ends, np.diff(np.append(-1, stop)))
        rises[lo:hi] = (ends + 1 < n) & (text[np.minimum(ends + 1, n - 1)] > own)
        run[lo:hi] = ends - np.arange(lo, hi) + 1
        end = int(ends[0])
    return rises, run


def induced_order(text: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, run: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common prefixes with the suffix before, from the S* suffixes in order."""
    n = len(text)
    empty = (np.zeros(0, np.int32), np.zeros(0, np.uint8))
    bounds = np.searchsorted(text[seeds], np.arange(257)) if len(seeds) else np.zeros(257, np.int64)
    falling: list = [empty] * 256
    pas = Inducer(text, memory)
    pas.queue.push(int(text[n - 1]), np.array([n - 1], np.int32), np.zeros(1, np.uint8))
    pas.filled[text[n - 1]] = True

    def joined(parts: list) -> tuple[np.ndarray, np.ndarray]:
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else empty

    for c in range(256):
        parts = []
        while layer := list(pas.queue.take(c)):
            for at, lcp in layer:
                parts.append((at, lcp))
                pas.induce(at, lcp, lambda ch, c=c: ch >= c)
        falling[c] = joined(parts)
        own = slice(bounds[c], bounds[c + 1])
        if own.stop > own.start:
            at, lcp = seeds[own], seed_lcp[own].copy()
            lcp[0] = min(int(run[at[0]]), int(run[falling[c][0][-1]]), CAP) if len(falling[c][0]) else 0
            pas.induce(at, lcp, lambda ch, c=c: ch > c)
    # S types from the largest down; values now tell the common prefix with the suffix after
    sa, out = [], []
    pas = Inducer(text, memory)
    for c in range(255, -1, -1):
        parts = []
        while layer := list(pas.queue.take(c)):
            for at, lcp in layer:
                parts.append((at, lcp))
                pas.induce(at, lcp, lambda ch, c=c: ch <= c)
        rising, up = joined(parts)
        at, lcp = falling[c]
        falling[c] = empty
        if len(at):
            edge = min(int(run[at[-1]]), int(run[rising[-1]]), CAP) if len(rising) else 0
            down = np.append(lcp[1:], np.uint8(edge))[::-1]
            pas.induce(at[::-1], down, lambda ch, c=c: ch < c)
        before = np.zeros(len(rising), np.uint8)
        if len(rising):
            before[:-1] = up[1:]
            before[-1] = min(int(run[at[-1]]), int(run[rising[-1]]), CAP) if len(at) else 0
            sa.append(rising[::-1])
            out.append(before[::-1])
        if len(at):
            sa.append(at)
            out.append(lcp)
    return np.concatenate(sa[::-1]), np.concatenate(out[::-1])


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes of pairs of suffixes, capped."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(CAP + 1, np.uint8)])
    out = np.zeros(len(a), np.uint8)
    for lo in range(0, len(a), BLOCK):
        x, y = a[lo:lo + BLOCK], b[lo:lo + BLOCK]
        live = np.arange(lo, lo + len(x))
        room = n - np.maximum(x, y)
        for k in range(CAP):
            same = (padded[x[live - lo] + k] == padded[y[live - lo] + k]) & (room[live - lo] > k)
            live = live[same]
            if not len(live):
                break
            out[live] += 1
    return out


def seed_order(text: np.ndarray, seeds: np.ndarray, run: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """S* suffixes in order (those that agree on `depth` characters and more in any order)."""
    m = len(seeds)
    by_char = seeds[np.argsort(text[seeds], kind="stable")]
    sa, _ = induced_order(text, by_char, np.zeros(m, np.uint8), run, memory)
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    first = sa[is_seed[sa]]  # ordered by their substrings up to the next S*
    del sa, is_seed
    rank_of = np.zeros(len(text), np.int32)
    rank_of[seeds] = np.arange(m)
    place = rank_of[first]  # index in text order
    del rank_of
    ends = np.append(seeds[1:], len(text) - 1)
    size = ends - seeds + 1
    # equal neighbours get one name: same length and same characters
    new = np.ones(m, bool)
    if m > 1:
        same = size[place[1:]] == size[place[:-1]]
        live = np.flatnonzero(same)
        k = 0
        while len(live):
            equal = text[np.minimum(first[live + 1] + k, len(text) - 1)] == text[np.minimum(first[live] + k, len(text) - 1)]
            same[live[~equal]] = False
            k += 1
            live = live[equal]
            live = live[size[place[live]] > k]
        new[1:] = ~same
    name = np.zeros(m, np.int64)
    name[place] = np.cumsum(new)
    span, reach = 1, int(size.min(initial=1))
    while name.max(initial=0) < m and span < m:
        follow = np.zeros(m, np.int64)
        follow[:m - span] = name[span:]
        order = np.lexsort((follow, name))
        a, b = name[order], follow[order]
        new = np.ones(m, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        name = np.empty(m, np.int64)
        name[order] = np.cumsum(new)
        span *= 2
        if span * max(1, reach - 1) > depth:
            break
    return seeds[np.argsort(name, kind="stable")]


def suffix_array(text: np.ndarray, depth: int = 200, memory: int = 64_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes with the suffix before), exact to `depth` characters."""
    if not len(text):
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    rises, run = suffix_types(text)
    star = rises.copy()
    star[1:] &= ~rises[:-1]
    star[0] = False
    seeds = np.flatnonzero(star).astype(np.int32)
    if len(seeds):
        seeds = seed_order(text, seeds, run, depth, memory)
        lcp = np.zeros(len(seeds), np.uint8)
        lcp[1:] = common_prefixes(text, seeds[:-1], seeds[1:])
    else:
        lcp = np.zeros(0, np.uint8)
    return induced_order(text, seeds, lcp, run, memory)
