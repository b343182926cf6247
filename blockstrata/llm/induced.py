"""Suffix order and common prefixes by induced sorting, in vectorised batches.

A priority queue holds suffix tuples (symbol, position, common prefix with the tuple
before). Induction takes all tuples of the least symbol at once, in the order in which they
were pushed, and pushes the suffixes one position earlier: pushed in suffix order, the
tuples of a symbol already stand in order, so the queue needs one spool for each symbol. The
common prefix of a pushed tuple with the one before it in its spool is one more than the least
common prefix scanned between their origins. Spools beyond a memory budget go to an
anonymous scratch file, which ends with the task, as Spark's own spills do. Only the queue
does: the text, its types and the order returned are in memory, so what is sorted at once
must fit it (exact_dedup.py makes its shards for that).

First the substrings between leftmost-smaller positions are sorted by induction and named;
where names are not unique, the reduced string of names is sorted in turn, by doubling: a
segment has few such positions, so a few rounds do. Then everything is induced from them.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

from blockstrata.llm._words import SYMBOL_CODES, prefix_hashes, span_hashes

SYMBOLS = 257
#: Common prefixes are counted up to this.
LONGEST = 250


class Queue:
    """A spool of (positions, common prefixes) batches for each symbol; beyond ``memory`` bytes batches are on disk."""

    def __init__(self, memory: int) -> None:
        self.memory, self.held, self.file = memory, 0, None
        self.spools: list[deque] = [deque() for _ in range(SYMBOLS)]

    def push(self, symbol: int, at: np.ndarray, lcp: np.ndarray) -> None:
        if self.held + at.nbytes + lcp.nbytes > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115
            where = self.file.seek(0, 2)
            self.file.write(at.tobytes())
            self.file.write(lcp.tobytes())
            self.spools[symbol].append((where, len(at)))
        else:
            self.held += at.nbytes + lcp.nbytes
            self.spools[symbol].append((at, lcp))

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All batches of a symbol, joined, as long as they fit the memory; None when there are none."""
        spool, got, size = self.spools[symbol], [], 0
        while spool and (not got or size < self.memory):
            a, b = spool.popleft()
            if isinstance(a, np.ndarray):
                self.held -= a.nbytes + b.nbytes
            else:
                self.file.seek(a)
                data = self.file.read(5 * b)
                a, b = np.frombuffer(data[: 4 * b], np.int32), np.frombuffer(data[4 * b :], np.uint8)
            got.append((a, b))
            size += a.nbytes + b.nbytes
        if len(got) < 2:
            return got[0] if got else None
        return np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got])


class _Scan:
    """What has been scanned last, and for each symbol the least common prefix since its last push."""

    def __init__(self, queue: Queue, text: np.ndarray, wanted: np.ndarray, carry: bool) -> None:
        self.queue, self.text, self.wanted, self.carry = queue, text, wanted, carry
        self.since, self.started = np.zeros(SYMBOLS, np.uint8), np.zeros(SYMBOLS, bool)

    def feed(self, at: np.ndarray, lcp: np.ndarray) -> None:
        """Scan a batch in order: push each one's predecessor where it is wanted."""
        source = np.flatnonzero(at > 0)
        before = at[source] - 1
        ok = self.wanted[before]
        source, before = source[ok], before[ok]
        symbol = self.text[before]
        if not len(symbol):
            if self.carry and len(lcp):
                self.since = np.minimum(self.since, lcp.min())
            return
        order = np.argsort(symbol, kind="stable")
        sorted_ = symbol[order]
        first = np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1
        bounds = [0, *first.tolist(), len(order)]
        least = int(lcp.min()) if self.carry and len(lcp) else 0
        fresh = np.minimum(self.since, least) if self.carry else self.since
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            s, own = int(sorted_[a]), order[a:b]
            values = np.zeros(len(own), np.uint8)
            if self.carry:
                k = source[own]
                values = np.minimum.reduceat(lcp[: k[-1] + 1], np.concatenate([[0], k[:-1] + 1]))
                values[0] = min(int(values[0]), int(self.since[s]))
                values = np.minimum(values, LONGEST - 1) + np.uint8(1)
                if not self.started[s]:
                    values[0] = 0
                fresh[s] = lcp[k[-1] + 1 :].min() if k[-1] + 1 < len(lcp) else 255
            self.started[s] = True
            self.queue.push(s, before[own], values)
        self.since = fresh


def _induce(text: np.ndarray, small: np.ndarray, starts: np.ndarray, lcp: np.ndarray, run: np.ndarray, memory: int, carry: bool) -> tuple[list, list]:
    """From sorted ``starts`` (leftmost-smaller positions), for each symbol: the larger-type suffixes in order, and the smaller-type ones in falling order."""
    def link(a: int, b: int) -> int:  # suffixes of one symbol and different type part where the shorter run ends
        return min(int(run[a]), int(run[b]), LONGEST)

    symbol = text[starts]
    bounds = np.searchsorted(symbol, np.arange(SYMBOLS + 1))
    queue = Queue(memory)
    scan = _Scan(queue, text, ~small, carry)
    large: list = []
    for s in range(SYMBOLS):
        got = []
        while (batch := queue.pop(s)) is not None:
            got.append(batch)
            scan.feed(*batch)
        own = tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int32), np.zeros(0, np.uint8))
        large.append(own)
        a, b = bounds[s], bounds[s + 1]
        if b > a:
            common = lcp[a:b].copy()
            common[0] = link(own[0][-1], starts[a]) if carry and len(own[0]) else 0
            scan.feed(starts[a:b], common)
    queue = Queue(memory)
    scan = _Scan(queue, text, small, carry)
    low: list = [None] * SYMBOLS
    for s in range(SYMBOLS - 1, -1, -1):
        got = []
        while (batch := queue.pop(s)) is not None:
            got.append(batch)
            scan.feed(*batch)
        own = tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int32), np.zeros(0, np.uint8))
        low[s] = own
        at, common = large[s]
        if len(at):
            back = np.zeros(len(at), np.uint8)
            back[1:] = common[:0:-1]
            back[0] = link(own[0][-1], at[-1]) if carry and len(own[0]) else 0
            scan.feed(at[::-1], back)
    return large, low


def _ranks_by_doubling(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names in which every segment ends with name 0; ties stay in place.

    A rank is the place of the first of its group; groups of one are settled and left out.
    """
    n, width = len(names), 1
    size = np.bincount(names)
    rank = (np.cumsum(size) - size)[names]
    live = np.flatnonzero((size[names] > 1) & (names != 0))
    while len(live) and width < n:
        ahead = rank[np.minimum(live + width, n - 1)]
        key = rank[live] * (n + 1) + ahead
        order = np.argsort(key)
        live, key = live[order], key[order]
        group = np.concatenate([[True], rank[live][1:] != rank[live][:-1]])
        new = np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(live))
        first, own = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        heads = np.flatnonzero(new)
        count = np.diff(np.append(heads, len(live)))
        rank[live] += own - first
        left = np.repeat(count > 1, count)
        # what met its segment's end together stays together
        over = names[np.minimum(live + width, n - 1)] == 0
        if not (left & ~over).any():
            break
        live, width = np.sort(live[left]), width * 2
    return np.argsort(rank, kind="stable")


def suffixes(segments: np.ndarray, memory: int = 256 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, common prefix of each with the one before, up to LONGEST).

    ``segments`` are symbols 1 to 256 (a byte plus one) with a 0 behind each segment; a
    suffix ends at its segment's 0, and equal ones may stand in any order.
    """
    text, n = segments.astype(np.uint16), len(segments)
    if n >= 1 << 31:
        raise ValueError("more than 2**31 symbols; sort them in shards")
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    change = np.flatnonzero(text[1:] != text[:-1])
    end = np.append(change, n - 1)  # last position of each run of one symbol
    length = np.diff(end, prepend=-1)
    run = np.minimum(np.repeat(end, length) - np.arange(n) + 1, LONGEST).astype(np.uint8)
    rising = np.append(text[change] < text[change + 1], True)  # a run before a larger symbol is of the smaller type
    small = np.repeat(rising, length)
    small[text == 0] = True
    run[text == 0] = 0
    first = small.copy()
    first[0] = False
    first[1:] &= ~small[:-1]
    first[text == 0] = True
    places = np.flatnonzero(first).astype(np.int32)
    # sort the substrings between such positions: by first symbol, then by induction
    start = places[np.argsort(text[places], kind="stable")]
    none = np.zeros(len(start), np.uint8)
    _, low = _induce(text, small, start, none, run, memory, False)
    order = np.concatenate([low[s][0][::-1] for s in range(SYMBOLS)])
    order = np.concatenate([start[text[start] == 0], order[first[order] & (text[order] != 0)]])
    if len(order) != len(places):  # the symbol before a segment's 0 is of the larger type, so every such position is induced
        raise AssertionError("induction lost a suffix")
    # equal substrings get one name
    follow = np.append(places[1:], n - 1)
    number = np.zeros(n, np.int32)
    number[places] = np.arange(len(places))
    nth = number[order]
    until = np.minimum(follow[nth] + 1, n)
    prefix = prefix_hashes(text, SYMBOL_CODES)
    key = span_hashes(prefix, order, np.where(text[order] == 0, order, until))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[1:] != key[:-1]) | ((until - order)[1:] != (until - order)[:-1]) & (text[order[1:]] != 0)
    names = np.zeros(len(places), np.int64)
    names[nth] = np.cumsum(fresh) - 1
    if len(np.unique(names[text[places] != 0])) < (text[places] != 0).sum():
        start = places[_ranks_by_doubling(names)]
    else:
        start = order
    large, low = _induce(text, small, start, _direct(text, start), run, memory, True)
    out, common = [], []
    zeros = np.flatnonzero(text == 0).astype(np.int32)
    out.append(zeros)
    common.append(np.zeros(len(zeros), np.uint8))
    for s in range(1, SYMBOLS):
        (a, la), (b, lb) = large[s], low[s]
        if len(a):
            out.append(a)
            common.append(la)
        if len(b):
            up = np.zeros(len(b), np.uint8)
            up[1:] = lb[:0:-1]
            up[0] = min(int(run[a[-1]]), int(run[b[-1]]), LONGEST) if len(a) else 0
            out.append(b[::-1])
            common.append(up)
    return np.concatenate(out), np.concatenate(common)


def _direct(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each position with the one before it, symbol by symbol, up to a segment's end."""
    out, live, depth = np.zeros(len(order), np.uint8), np.arange(1, len(order)), 0
    n = len(text)
    while len(live) and depth < LONGEST:
        a, b = np.minimum(order[live] + depth, n - 1), np.minimum(order[live - 1] + depth, n - 1)
        live = live[(text[a] == text[b]) & (text[a] != 0)]
        depth += 1
        out[live] = depth
    return out
