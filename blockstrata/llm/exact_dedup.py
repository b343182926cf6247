"""Repeated passages by suffix sorting: bytes covered by a string of ``length`` bytes that also starts in a document with a smaller doc_id.

A suffix array of everything would be many times the input, so only what can match is
sorted, and in shards that need not know of each other. In each window of ``length``
bytes the 16-byte gram of least hash is its anchor; equal windows have equal anchors, and
consecutive windows of one anchor make one segment. Anchors that occur in one document
alone are dropped, exactly: each block of texts sends its distinct anchors to a shard by
their hash and is told which other blocks have. The other segments go to shards by anchor,
each distinct one once a block, with the least doc_id that has it. An anchor with more
segments than a shard should hold (a common line in ever other context) is split: each of
its windows goes for itself, to the shard of its own hash. A shard orders the
suffixes of its distinct segments by induced sorting (induced.py); neighbours with
a common prefix of ``length`` or more are one string, whose least doc_id follows; a
segment needs sorting only if its anchor, with half of a window's other bytes before or behind it,
is another's too, as no other can match it. A block
gets back a bit for each window of what it sent: whether a smaller document than its own
has it.

A shard's distinct segments are sorted in memory, and are made to fit: some megabytes of
text, and without split anchors. A segment or window of a third of all documents is held once
by its shard, and costs 28 bytes a block in a scratch file. Blocks are kept compressed,
read three times, and rows of one block never leave it.

Defined results: null counts as empty; a null doc_id sorts behind all others; documents of
one doc_id don't remove from each other; texts of any length are taken whole; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import tempfile
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockstrata.llm._base import Staged, grouped, small_batches, spread, text_chunks, tidied
from blockstrata.llm._words import U64, prefix_hashes, run_hashes, span_hashes
from blockstrata.llm.induced import suffixes

GRAM = 16
#: Text bytes for which a shard is made, at least.
SHARD = 4 << 20
#: An anchor is split from one segment for so many of a shard's bytes on; blocks give counts beyond FEW, fewer count as one.
SPLIT, FEW = 128, 4
#: Bytes in a block of a small input, and in what is worked on at once: few enough to stay in a core's cache.
BLOCK, _STRIP = 2 << 20, 1 << 15
#: From so many blocks on they grow instead, up to so many times: what shuffles hold is rows by blocks and shards.
MANY_BLOCKS, MOST_GROWN = 512, 4
_LOW = U64((1 << 40) - 1)
#: The bits of a gram's hash that its place takes when the least is looked for.
_PLACE = U64(2 * _STRIP - 1)
_PLACES = np.arange(2 * _STRIP, dtype=np.uint64)
_LAST = np.iinfo(np.int64).max


def _shrunk(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _grown(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if len(data) > 8 else b""


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return _shrunk(sink.getvalue().to_pybytes())


def _unpacked(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(_grown(data)).read_next_batch()


def _joined(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``least`` bytes or more, but for the last."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held) if len(held) > 1 else batch
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def blocks(docs: DataFrame, keep: Sequence[str] = (), block_bytes: int = BLOCK) -> DataFrame:
    """block, ids (8 bytes each, and a byte each for a null id and for a null text), offs, raw, rest (other columns): about ``block_bytes`` of texts each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in _joined(batches, block_bytes):
            for a, e, raw, offs in text_chunks(batch.column(1), block_bytes):
                own, text = batch.column(0).slice(a, e - a), batch.column(1).slice(a, e - a)
                ids = own.fill_null(_LAST).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
                null = b"".join(np.asarray(c.is_null()).astype(np.uint8).tobytes() for c in (own, text))
                rest = _packed(batch.select(range(2, batch.num_columns)).slice(a, e - a)) if keep else b""
                yield pa.RecordBatch.from_arrays([pa.array([block]), *(pa.array([x], pa.binary()) for x in (ids + null, offs.astype("<i8").tobytes(), _shrunk(raw.tobytes()), rest))], ["block", "ids", "offs", "raw", "rest"])
                block += 1

    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(tidied(run, each=True), "block long, ids binary, offs binary, raw binary, rest binary")


class Block:
    """A block's texts, and the segments of its windows: ``start``, ``windows`` (how many), ``anchor`` (hash), ``doc`` (its doc_id)."""

    def __init__(self, ids: bytes, offs: bytes, raw: bytes, length: int) -> None:
        n = len(ids) // 10
        self.ids, self.null, self.textless = np.frombuffer(ids, "<i8", n), np.frombuffer(ids, np.uint8, n, 8 * n), np.frombuffer(ids, np.uint8, n, 9 * n)
        self.offs, self.raw = np.frombuffer(offs, "<i8"), np.frombuffer(_grown(raw), np.uint8)
        self.length = length
        parts = [self._segments(at, min(len(self.raw), at + _STRIP + length - 1)) for at in range(0, len(self.raw), _STRIP)]
        self.start, self.windows, self.anchor = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        self.anchor = self.anchor.astype(np.uint64)
        self.doc = self.ids[np.searchsorted(self.offs, self.start, side="right") - 1]

    def _segments(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, length = self.raw[lo:hi], self.length
        wide, count = length - GRAM + 1, len(raw) - GRAM + 1
        if count < wide:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashes = run_hashes(prefix_hashes(raw), GRAM)
        least, span = hashes & ~_PLACE, 1
        least |= _PLACES[:count]
        while span * 2 <= wide:
            least, span = np.minimum(least[: len(least) - span], least[span:]), span * 2
        if span < wide:
            least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
        n = min(len(least), _STRIP)
        place = (least[:n] & _PLACE).view(np.int64)
        new = np.ones(n, bool)
        np.not_equal(place[1:], place[:-1], out=new[1:])
        # a window lies in one document if none ends inside
        ends = self.offs[np.searchsorted(self.offs, lo, side="right") : np.searchsorted(self.offs, hi)] - lo
        if not len(ends):
            first = np.flatnonzero(new)
            return first + lo, np.diff(first, append=n), hashes[place[first]]
        ended = np.zeros(len(raw) + 1, np.int32)
        np.add.at(ended, ends, 1)
        ended = np.cumsum(ended, dtype=np.int32)
        window = np.flatnonzero(ended[:n] == ended[length - 1 : length - 1 + n])
        place, new = place[window], new[window]
        new[:1] = True
        new[1:] |= window[1:] != window[:-1] + 1
        first = np.flatnonzero(new)
        return window[first] + lo, np.diff(np.append(first, len(window))), hashes[place[first]]

    def keys(self, shards: int) -> np.ndarray:
        """Shard and 40 bits of each segment's anchor."""
        return ((self.anchor >> U64(40)) % U64(shards)) << U64(40) | (self.anchor & _LOW)

    def shared(self, shards: int, bits: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Segments whose anchors another document has, in another block, as ``bits`` say, or in this one; and whether the anchor is split."""
        unique, inverse = np.unique(self.keys(shards), return_inverse=True)
        out, split = np.zeros((2, len(unique)), bool)
        bounds = np.searchsorted(unique, np.arange(shards + 1, dtype=np.uint64) << U64(40))
        for s, b in bits.items():
            n = int(bounds[s + 1] - bounds[s])
            for flags, part in ((out, b[: -(-n // 8)]), (split, b[-(-n // 8) :])):
                if part:
                    flags[bounds[s] : bounds[s + 1]] = np.unpackbits(np.frombuffer(part, np.uint8), count=n).astype(bool)
        low, high = np.full(len(unique), _LAST), np.full(len(unique), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, self.doc)
        np.maximum.at(high, inverse, self.doc)
        own = np.flatnonzero((out | (low != high))[inverse])
        return own, split[inverse[own]]

    def dealt(self, shards: int, bits: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, windows, doc, shard) of what is shared: segments, and each window of those with a split anchor, whose shard is -1."""
        own, split = self.shared(shards, bits)
        whole, cut = own[~split], own[split]
        n = self.windows[cut]
        total = int(n.sum())
        start = np.repeat(self.start[cut] - (np.cumsum(n) - n), n) + np.arange(total)
        shard = (self.keys(shards)[whole] >> U64(40)).astype(np.int64)
        return (
            np.concatenate([self.start[whole], start]), np.concatenate([self.windows[whole], np.ones(total, np.int64)]),
            np.concatenate([self.doc[whole], np.repeat(self.doc[cut], n)]), np.concatenate([shard, np.full(total, -1)]),
        )

    def entries(self, start: np.ndarray, windows: np.ndarray, doc: np.ndarray, shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct ones of what is dealt, by shard: (one of each, its shard, its least doc, the entry of each)."""
        end = start + windows + self.length - 1
        hashes = np.zeros(len(start), np.uint64)
        strip = start // _STRIP
        for s in np.unique(strip):
            at = np.flatnonzero(strip == s)
            lo = int(start[at].min())
            hashes[at] = span_hashes(prefix_hashes(self.raw[lo : int(end[at].max())]), start[at] - lo, end[at] - lo)
        shard = np.where(shard < 0, ((hashes >> U64(40)) % U64(shards)).astype(np.int64), shard)
        order = np.lexsort((hashes, shard))
        new = np.ones(len(start), bool)
        new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (shard[order][1:] != shard[order][:-1])
        entry = np.empty(len(start), np.int64)
        entry[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), _LAST)
        np.minimum.at(least, entry, doc)
        return order[new], shard[order[new]], least, entry

    def gather(self, starts: np.ndarray, sizes: np.ndarray) -> bytes:
        """Their bytes end to end."""
        parts = []
        for at in range(0, len(starts), 4096):
            start, size = starts[at : at + 4096], sizes[at : at + 4096]
            parts.append(self.raw[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(parts)


def _by_shard(shard: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    bounds = np.searchsorted(shard, np.arange(shards + 1))
    return [(s, slice(bounds[s], bounds[s + 1])) for s in range(shards) if bounds[s] < bounds[s + 1]]


def _many(count: np.ndarray) -> bytes:
    at = np.flatnonzero(count > FEW)
    return np.stack([at, count[at]], 1).astype("<u4").tobytes()


def _anchors(table: DataFrame, length: int, shards: int) -> DataFrame:
    """shard, block, anchors (5 bytes each), many: a block's distinct ones, and (place, count) of those with more than FEW segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            name, *rest = (batch.column(k)[0].as_py() for k in range(4))
            unique, count = np.unique(Block(*rest, length).keys(shards), return_counts=True)
            low = unique.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            parts = _by_shard((unique >> U64(40)).astype(np.int64), shards)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([name] * len(parts), pa.int64()), pa.array([low[at].tobytes() for _, at in parts], pa.binary()), pa.array([_many(count[at]) for _, at in parts], pa.binary())], ["shard", "block", "anchors", "many"])

    return table.mapInArrow(tidied(run, each=True), "shard int, block long, anchors binary, many binary")


def _elsewhere(anchors: DataFrame, shards: int, most: int) -> DataFrame:
    """block, shard, bits: which of a block's anchors another block has; behind them, if any are, which are split, as all blocks together have over ``most`` segments."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs in grouped(iter(batches), 1):
            for s, e in zip(offs[:-1], offs[1:], strict=True):
                sent = rows.column(2).slice(s, e - s).to_pylist()
                size = np.array([len(x) // 5 for x in sent])
                wide = np.zeros((int(size.sum()), 8), np.uint8)
                wide[:, :5] = np.frombuffer(b"".join(sent), np.uint8).reshape(-1, 5)
                _, inverse, count = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
                more = np.split(count[inverse] > 1, np.cumsum(size)[:-1])
                segments = np.ones(len(inverse), np.int64)
                for low, many in zip(np.cumsum(size) - size, rows.column(3).slice(s, e - s).to_pylist(), strict=True):
                    at = np.frombuffer(many, "<u4").reshape(-1, 2)
                    segments[low + at[:, 0]] = at[:, 1]
                split = np.split((np.bincount(inverse, segments) > most)[inverse], np.cumsum(size)[:-1])
                yield pa.RecordBatch.from_arrays([rows.column(1).slice(s, e - s), rows.column(0).slice(s, e - s), pa.array([np.packbits(x).tobytes() + (np.packbits(y).tobytes() if y.any() else b"") for x, y in zip(more, split, strict=True)], pa.binary())], ["block", "shard", "bits"])

    return anchors.repartition(spread(anchors.sparkSession, min(shards, 4096)), "shard").sortWithinPartitions("shard", "block").mapInArrow(tidied(run, each=True), "block long, shard int, bits binary")


def _collected(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("shard", name))).alias(name))


def _sent(table: DataFrame, length: int, shards: int) -> DataFrame:
    """shard, block, least (doc_id), size, chars: a block's distinct shared segments, from blocks with their bits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            name, *rest, bits = (batch.column(k)[0].as_py() for k in range(5))
            block = Block(*rest, length)
            dealt = block.dealt(shards, dict(bits or ()))
            one, shard, least, _ = block.entries(*dealt, shards)
            start, size = dealt[0][one], (dealt[1][one] + length - 1).astype("<u2")
            parts = _by_shard(shard, shards)
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()), pa.array([name] * len(parts), pa.int64()), pa.array([least[at].astype("<i8").tobytes() for _, at in parts], pa.binary()), pa.array([size[at].tobytes() for _, at in parts], pa.binary()), pa.array([_shrunk(block.gather(start[at], size[at].astype(np.int64))) for _, at in parts], pa.binary())], ["shard", "block", "least", "size", "chars"])

    return table.mapInArrow(tidied(run, each=True), "shard int, block long, least binary, size binary, chars binary")


def _hashes(chars: np.ndarray, start: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each segment, and (2, segments) hashes of the anchor with what is before and behind it, some thousands at a time; 0 where a segment has too little.

    Every window has its anchor and, before or behind it, half of its other bytes at least: so segments that share a
    window share one of the two.
    """
    key, sides = np.zeros(len(size), np.uint64), np.zeros((2, len(size)), np.uint64)
    half = -(-(length - GRAM) // 2)
    for at in range(0, len(size), 4096):
        own = slice(at, at + 4096)
        low = start[at]
        prefix = prefix_hashes(chars[low : start[own][-1] + size[own][-1]])
        begin = start[own] - low
        end = begin + size[own]
        key[own] = span_hashes(prefix, begin, end) ^ size[own].astype(np.uint64)
        grams = run_hashes(prefix, GRAM)[begin[:, None] + np.arange(length - GRAM + 1)]
        place = (grams & ~_PLACE).argmin(1)
        place += begin
        for side, (a, b) in zip(sides, ((place - half, place + GRAM), (place, place + GRAM + half)), strict=True):
            has = (a >= begin) & (b <= end)
            side[at : at + len(has)][has] = span_hashes(prefix, a[has], b[has])
    return key, sides


def _shared_sides(sides: np.ndarray) -> np.ndarray:
    """Segments of which one side is another's too."""
    out = np.zeros(sides.shape[1], bool)
    for side in sides:
        has = np.flatnonzero(side)
        _, which, count = np.unique(side[has], return_inverse=True, return_counts=True)
        out[has] |= count[which] > 1
    return out


class Shard:
    """What blocks send to a shard: each distinct segment is held once, and which of them an entry is goes to a scratch file once there are more.

    The scratch file ends with the task. Rows are taken in by ``at_once`` bytes; a shard below that has no file.
    """

    def __init__(self, length: int, at_once: int) -> None:
        self.length, self.at_once = length, at_once
        self.waiting: list[tuple[int, bytes, bytes, bytes]] = []
        self.bytes = 0
        self.file = None
        self.last: tuple[np.ndarray, ...] | None = None
        self.key, self.sides = np.zeros(0, np.uint64), np.zeros((2, 0), np.uint64)
        self.docs, self.size, self.chars = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def add(self, block: int, least: bytes, size: bytes, chars: bytes) -> None:
        """An entry is a segment of a block: its least doc_id, its bytes (``chars`` has all, compressed)."""
        self.waiting.append((block, least, size, chars))
        self.bytes += len(least) + len(size) + int.from_bytes(chars[:8], "little")
        if self.bytes >= self.at_once:
            self._take_in()

    def _take_in(self) -> None:
        if self.last is not None:
            if self.file is None:
                self.file = tempfile.TemporaryFile()  # noqa: SIM115
            for part in self.last:
                np.save(self.file, part)
        blocks, counts = np.array([w[0] for w in self.waiting], np.int64), np.array([len(w[2]) // 2 for w in self.waiting], np.int64)
        least, size = (np.frombuffer(b"".join(w[k] for w in self.waiting), t).astype(np.int64) for k, t in ((1, "<i8"), (2, "<u2")))
        chars = np.frombuffer(b"".join(_grown(w[3]) for w in self.waiting), np.uint8)
        self.waiting, self.bytes = [], 0
        end = np.cumsum(size)
        key, sides = _hashes(chars, end - size, size, self.length)
        unique, first, entry = np.unique(key, return_index=True, return_inverse=True)
        number, order = np.arange(len(unique)), np.argsort(self.key)
        if len(order):  # those already held keep their numbers
            place = np.minimum(np.searchsorted(self.key, unique, sorter=order), len(order) - 1)
            known = self.key[order[place]] == unique
            number = np.where(known, order[place], len(order) + np.cumsum(~known) - 1)
            first, unique = first[~known], unique[~known]
        new = size[first]
        at = np.repeat((end - size)[first] - (np.cumsum(new) - new), new)
        at += np.arange(len(at))
        self.chars = np.concatenate([self.chars, chars[at]]) if len(self.chars) else chars[at]
        self.key, self.sides, self.size = np.concatenate([self.key, unique]), np.concatenate([self.sides, sides[:, first]], axis=1), np.concatenate([self.size, new])
        self.docs = np.concatenate([self.docs, np.full(len(first), _LAST)])
        entry = number[entry]
        np.minimum.at(self.docs, entry, least)
        self.last = blocks, counts, entry.astype(np.int32), least

    def _taken_in(self) -> Iterator[tuple[np.ndarray, ...]]:
        if self.file is not None:
            end = self.file.tell()
            self.file.seek(0)
            while self.file.tell() < end:
                yield tuple(np.load(self.file) for _ in range(4))
        if self.last is not None:
            yield self.last

    def earlier(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(blocks, how many entries of each, for each entry a bit for each window: whether a smaller doc has it)."""
        if self.waiting:
            self._take_in()
        windows = self.size - self.length + 1
        base = np.cumsum(windows) - windows
        found = _found(self.docs, self.sides, self.size, self.chars, self.length)
        for blocks, counts, entry, least in self._taken_in():
            bits = np.zeros(len(entry), np.uint64)
            for o in range(int(windows[entry].max()) if len(entry) else 0):
                has = windows[entry] > o
                bits[has] |= (found[base[entry[has]] + o] < least[has]).astype(np.uint64) << U64(o)
            yield blocks, counts, bits


def _found(docs: np.ndarray, sides: np.ndarray, size: np.ndarray, chars: np.ndarray, length: int) -> np.ndarray:
    """The least doc of each window of each of a shard's distinct segments (``size`` bytes of ``chars``, first in ``docs``)."""
    windows = size - length + 1
    found = np.repeat(docs, windows)
    base = np.cumsum(windows) - windows
    # windows of different segments can only be equal where the segments have one anchor, and half of what is around it, in common
    start = np.cumsum(size) - size
    own = np.flatnonzero(_shared_sides(sides))
    if len(own):
        n = size[own]
        total = int(n.sum())
        place = np.cumsum(n + 1) - n - 1  # of each segment in what is sorted
        text = np.zeros(total + len(n), np.uint16)
        for at in range(0, len(n), 4096):
            some = n[at : at + 4096]
            step, gap = np.arange(int(some.sum())), np.cumsum(some) - some
            text[step + np.repeat(place[at : at + 4096] - gap, some)] = chars[step + np.repeat(start[own[at : at + 4096]] - gap, some)].astype(np.uint16) + 1
        order, common = suffixes(text)
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        left = (place + n).astype(np.int32)[owner] - np.arange(len(text), dtype=np.int32)
        full = left[order] >= length  # equal windows are neighbours, for what is between them has their bytes too
        order = order[full]
        group = np.flatnonzero(np.append(True, common[full][1:] < length))
        smallest = np.minimum.reduceat(docs[own][owner[order]], group)
        found[base[own][owner[order]] + order - place[owner[order]]] = np.repeat(smallest, np.diff(np.append(group, len(order))))
    return found


def _earlier(sent: DataFrame, length: int, shards: int, at_once: int = SHARD) -> DataFrame:
    """block, shard, earlier (5 bytes an entry): bits of the windows that a smaller document has."""

    def told(name: int, shard: Shard) -> Iterator[pa.RecordBatch]:
        for blocks, counts, bits in shard.earlier():
            packed = np.split(bits.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5], np.cumsum(counts)[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.full(len(blocks), name, np.int32)), pa.array([_shrunk(x.tobytes()) for x in packed], pa.binary())], ["block", "shard", "earlier"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = -1, Shard(length, at_once)
        for batch in batches:
            for row in range(batch.num_rows):
                at, *rest = (batch.column(k)[row].as_py() for k in range(5))
                if at != name:
                    yield from told(name, shard)
                    name, shard = at, Shard(length, at_once)
                shard.add(*rest)
        yield from told(name, shard)

    return sent.repartition(spread(sent.sparkSession, min(shards, 4096)), "shard").sortWithinPartitions("shard", "block").mapInArrow(tidied(run, each=True), "block long, shard int, earlier binary")


def _removed(block: Block, shards: int, bits: dict[int, bytes], earlier: dict[int, bytes]) -> np.ndarray:
    """Whether each byte of a block goes."""
    start, windows, doc, by = block.dealt(shards, bits)
    _, shard, least, entry = block.entries(start, windows, doc, by, shards)
    wide = np.zeros((len(least), 8), np.uint8)
    for s, at in _by_shard(shard, shards):
        wide[at, :5] = np.frombuffer(_grown(earlier[s]), np.uint8).reshape(-1, 5)
    mask = wide.view("<u8").ravel()[entry]
    mask[doc > least[entry]] = np.iinfo(np.uint64).max
    change = np.zeros(len(block.raw) + 1, np.int32)
    for o in range(block.length - GRAM + 1):
        at = start[(mask >> U64(o) & U64(1)).astype(bool) & (windows > o)] + o
        np.add.at(change, at, 1)
        np.subtract.at(change, at + block.length, 1)
    return np.cumsum(change)[:-1] > 0


def grown(block_bytes: int, total: int) -> int:
    """Bytes of a block where there are ``total`` bytes of text."""
    return max(block_bytes, min(MOST_GROWN * block_bytes, total // MANY_BLOCKS))


def cut(docs: DataFrame, length: int = 50, keep: Sequence[str] = (), with_text: bool = False, block_bytes: int = BLOCK, shard_bytes: int = SHARD, left: list[Staged] | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each of ``docs`` (doc_id, text), before them its ``keep`` columns; ``kept_text``, what stays without characters that were cut in part (null for null), if asked for. Smaller blocks and shards take less memory at a time and more rows in shuffles; with more than MANY_BLOCKS blocks are larger. ``left`` gets the tables that the result reads."""
    spark = docs.sparkSession
    if not GRAM < length <= GRAM + 39:  # a segment's windows fit 40 bits
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + 39}")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = Staged(blocks(docs, keep, grown(block_bytes, total)), "blocks")
    size = table.read().agg(F.sum(F.octet_length("offs")), F.sum(F.octet_length("raw"))).first()
    shards = spread(spark, -(-3 * (size[1] or 0) // shard_bytes))
    bits = Staged(_elsewhere(_anchors(table.read().drop("rest"), length, shards), shards, shard_bytes // SPLIT), "bits")
    _release(spark)
    flagged = table.read().drop("rest").join(_collected(bits.read(), "bits"), "block", "left")
    earlier = Staged(_earlier(_sent(flagged.select("block", "ids", "offs", "raw", "bits"), length, shards), length, shards, shard_bytes), "earlier")
    _release(spark)
    if left is not None:
        left += [table, bits, earlier]
    told = _collected(bits.read(), "bits").join(_collected(earlier.read(), "earlier"), "block", "full")
    both = table.read().join(told, "block", "left").select("block", "ids", "offs", "raw", "bits", "earlier", "rest")
    added = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    schema = T.StructType([*docs.select(*keep).schema, *T.StructType.fromDDL(added)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            _, *own, bits, earlier, rest = (batch.column(k)[0].as_py() for k in range(7))
            block = Block(*own, length)
            gone = _removed(block, shards, dict(bits or ()), dict(earlier or ()))
            total = np.concatenate([[0], np.cumsum(gone)])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            opens[block.offs[:-1][block.offs[:-1] < len(gone)]] |= gone[block.offs[:-1][block.offs[:-1] < len(gone)]]
            spans = np.concatenate([[0], np.cumsum(opens)])
            o = block.offs
            kept = [block.raw[a:b].tobytes() if total[a] == total[b] else block.raw[a:b][~gone[a:b]].tobytes() for a, b in zip(o[:-1], o[1:], strict=True)]
            columns = [pa.array(block.ids, mask=block.null.astype(bool)), pa.array(np.diff(o)), pa.array(total[o[1:]] - total[o[:-1]]), pa.array(spans[o[1:]] - spans[o[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            if with_text:
                columns.append(pa.array([None if n else k.decode("utf-8", "ignore") for k, n in zip(kept, block.textless, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*(_unpacked(rest).columns if rest else []), *columns], schema.names)

    return both.mapInArrow(tidied(run, each=True), schema)


def _release(spark: object) -> None:
    """Shuffle files of plans that are done go when the driver's garbage is collected; do that before the next large one."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
