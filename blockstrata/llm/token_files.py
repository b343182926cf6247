"""Token-ID output as patched frame-of-reference blocks, and reading it back.

A file holds the ids of consecutive documents. After a header with the documents'
ids and lengths and an index of block starts come blocks of 256 ids: the block's
minimum is subtracted, the rest packed as bit planes at the width that covers a
chosen percentile of the block, and ids that don't fit are listed as exceptions.

Files are rows of a Parquet table (part, seq, content): Spark's own writer commits
them, so a task run twice leaves one copy and any file system that Spark writes to
will do. ``export`` gives them as plain files.

Chunks of text between single spaces are encoded once and kept in a bounded table;
a text in which white space stands together is given to the tokenizer whole. Both
give what the library gives for the whole text.

Defined results: null and empty texts have only the end id; documents come in
ascending order of id, null first, ties by a hash of the text; extra columns are
ignored; an empty table gives no file.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.llm._base import TABLES, small_batches, spread, text_chunks, tidied
from blockstrata.llm._words import distinct, prefix_hashes, span_hashes

BLOCK = 256
_MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIQIQ")
_ENCODERS: dict[str, ChunkEncoder] = {}
TABLES.append(_ENCODERS.clear)
_CONTROL_SPACE = np.zeros(256, bool)
_CONTROL_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31]] = True
#: Runs of these behind letters are one piece by themselves.
_SYMBOLS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
_FIRST = np.uint64(0x5851F42D4C957F2D)


class _Table:
    """ids by 64-bit key, in sorted arrays: a large level and a small one for what is new, and the ids of all end to end."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in range(2)]
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of sorted keys begin, -1 for unknown ones, and how many each has."""
        start, length = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        for known, starts, lengths in self.levels:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                start[hit], length[hit] = starts[at[hit]], lengths[at[hit]]
        return start, length

    def store(self, ids: np.ndarray) -> int:
        """Put ids behind all others; returns where."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + len(ids), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def add(self, keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Sorted keys that are new."""
        self.levels[1] = self._merged(self.levels[1], (keys, starts, lengths.astype(np.int32)))
        if len(self.levels[1][0]) > 50_000 + len(self.levels[0][0]) // 4:
            self.levels = [self._merged(*self.levels), tuple(x[:0] for x in self.levels[1])]

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def __len__(self) -> int:
        return sum(len(level[0]) for level in self.levels)


class ChunkEncoder:
    """ids of texts by way of a bounded table of distinct chunks, keyed by 64-bit hashes."""

    def __init__(self, path: str, most: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), _Table(most)
        self.special = {t.content.encode()[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        # byte-level models write printable bytes as themselves and the others from U+0100 on, and take a run of
        # letters behind a space as one piece; proved on the library itself
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.table = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.model, self.marks = self.tokenizer.model, {"": b""}
        words = ("the", "Xyzzyqu", "a", "incomprehensibilities", "don", "\u00e9t\u00e9", "Stra\u00dfe", "a\u00f1o", "\u00c0\u0142\u0177", "\u00aa")
        probes = [f"{w}{m}" for w in words for m in ("", ".", ",!!", "$$$", "%&|<>", "...", "\n", ".\nNext", "\n\u00e9t\u00e9.", "'")]
        self.direct = True
        self.direct = all(self._whole(space + p) == self._pieces(p, space) for space in ("", " ") for p in probes if p[-1] != "\n")

    @staticmethod
    def of(path: str, most: int = 1_500_000) -> ChunkEncoder:
        if path not in _ENCODERS or _ENCODERS[path].known.most != most:
            _ENCODERS[path] = ChunkEncoder(path, most)
        return _ENCODERS[path]

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, word: str, space: str) -> bytes:
        """ids of a chunk and the space before it; letters with symbols behind them go straight to the library's model."""
        core = word.rstrip(_SYMBOLS)
        if self.direct and core:
            if core.isalpha() and max(core) < "\u0250":
                rest = word[len(core) :]
                if rest not in self.marks:
                    if len(self.marks) > 10_000:
                        self.marks.clear()
                        self.marks[""] = b""
                    self.marks[rest] = self._whole(rest)
                plain = core if core.isascii() else core.encode().decode("latin-1").translate(self.table)
                return array("I", [t.id for t in self.model.tokenize("\u0120" + plain if space else plain)]).tobytes() + self.marks[rest]
            left, line, right = word.partition("\n")
            if line and left and right and left[-1] not in _SPACES and right[0] not in _SPACES:
                return self._pieces(left, space) + self._pieces_of_line() + self._pieces(right, "")
        return self._whole(space + word)

    def _learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, opens: np.ndarray) -> list[bytes]:
        """ids of chunks, each without the space that is before it unless it opens a text."""
        if not len(starts):
            return []
        length = ends - starts
        joined = np.full(int(length.sum()) + len(starts), 0xFF, np.uint8)  # a byte that UTF-8 never has divides them
        first = np.cumsum(length + 1) - length - 1
        joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(starts)), length)] = raw[np.arange(int(length.sum())) + np.repeat(starts - first + np.arange(len(starts)), length)]
        words = joined[:-1].tobytes().decode("utf-8", "surrogateescape").split("\udcff")
        out, direct, tokenize, marks, pieces = [], self.direct, self.model.tokenize, self.marks, self._pieces
        for word, start in zip(words, opens.tolist(), strict=True):
            core = word.rstrip(_SYMBOLS)
            if direct and not start and core.isascii() and core.isalpha() and (rest := word[len(core) :]) in marks:
                out.append(array("I", [t.id for t in tokenize("\u0120" + core)]).tobytes() + marks[rest])
            else:
                out.append(pieces(word, "" if start else " "))
        return out

    def _pieces_of_line(self) -> bytes:
        if "\n" not in self.marks:
            self.marks["\n"] = self._whole("\n")
        return self.marks["\n"]

    def _together(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Texts that must be encoded whole: white space stands beside a space, at an end, or is of a rare kind; or a special token may begin."""
        bad = np.zeros(len(offs) - 1, bool)
        full = np.diff(offs) > 0
        bad[full] = (raw[offs[:-1][full]] == 32) | (raw[offs[1:][full] - 1] == 32)
        if len(raw) > 1:
            space, control = raw == 32, _CONTROL_SPACE[raw]
            at = [np.flatnonzero((space[:-1] & (space[1:] | control[1:])) | (control[:-1] & space[1:]))]
            for lead, seconds in ((0xC2, (0x85, 0xA0)), (0xE1, (0x9A,)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,)), *((x[0], tuple(x[1:2])) for x in self.special)):
                found = np.flatnonzero(raw[:-1] == lead)
                found = found[np.isin(raw[found + 1], seconds)]
                if lead == 0xE2:  # of these only U+2000 to U+200A, U+2028, U+2029, U+202F and U+205F are space
                    third = raw[np.minimum(found + 2, len(raw) - 1)]
                    found = found[(third <= 0x8A) | np.isin(third, (0xA8, 0xA9, 0xAF, 0x9F))]
                at.append(found)
            at = np.concatenate(at)
            bad[np.searchsorted(offs, at, side="right") - 1] = True
        return bad

    def chunks(self, column: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids of their texts end to end, offsets of each text's ids)."""
        for a, e, raw, offs in text_chunks(column, most_bytes):
            bad = self._together(raw, offs)
            prefix = prefix_hashes(raw)
            spaces = np.flatnonzero(raw == 32)
            if bad.any():
                spaces = spaces[~bad[np.searchsorted(offs, spaces, side="right") - 1]]
            firsts = offs[:-1][~bad & (np.diff(offs) > 0)]
            starts, ends = np.concatenate([firsts, spaces + 1]), np.concatenate([spaces, offs[1:][~bad & (np.diff(offs) > 0)]])
            order = np.argsort(starts, kind="stable")
            opens = (np.arange(len(starts)) < len(firsts))[order]
            starts, ends = starts[order], np.sort(ends)
            key = span_hashes(prefix, starts, ends)
            key[opens] ^= _FIRST
            unique, index, inverse = distinct(key)
            known = self.known
            if len(known) > known.most:
                known.clear()
            start, length = known.find(unique)
            unseen = np.flatnonzero(start < 0)
            if len(unseen):
                learnt = self._learn(raw, starts[index[unseen]], ends[index[unseen]], opens[index[unseen]])
                length[unseen] = np.fromiter(map(len, learnt), np.int64, len(learnt)) // 4
                start[unseen] = known.store(np.frombuffer(b"".join(learnt), "<u4")) + np.cumsum(length[unseen]) - length[unseen]
                known.add(unique[unseen], start[unseen], length[unseen])
            before, whole = known.used, [np.frombuffer(self._whole(raw[offs[i] : offs[i + 1]].tobytes().decode()), "<u4") for i in np.flatnonzero(bad)]
            # the texts encoded whole stand as one chunk each
            start = np.concatenate([start, [known.store(ids) for ids in whole]]).astype(np.int64)
            length = np.concatenate([length, [len(ids) for ids in whole]]).astype(np.int64)
            starts = np.concatenate([starts, offs[:-1][bad]])
            inverse = np.concatenate([inverse, len(unique) + np.arange(len(whole))])
            order = np.argsort(starts, kind="stable")
            starts, inverse = starts[order], inverse[order]
            count = length[inverse]
            total = np.zeros(len(count) + 1, np.int64)
            np.cumsum(count, out=total[1:])
            at = np.repeat(start[inverse] - total[:-1], count) + np.arange(total[-1])
            ids = known.pool[at]
            known.used = before
            yield a, e, ids, total[np.searchsorted(starts, offs)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit bytes."""
        return [ids[s:e].tobytes() for _, _, ids, at in self.chunks(pa.array(texts, pa.string())) for s, e in zip(at[:-1], at[1:], strict=True)]


def pack(values: np.ndarray, percentile: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all blocks, their starts) of unsigned 32-bit values."""
    n = -(-len(values) // BLOCK)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.uint64)
    v = np.empty(n * BLOCK, np.uint32)
    v[: len(values)], v[len(values) :] = values, values[-1]
    v = v.reshape(n, BLOCK)
    least = v.min(1)
    v = v - least[:, None]
    bits = np.frexp(v.astype(np.float64))[1].astype(np.uint8)  # bit lengths
    width = np.partition(bits, int(percentile * (BLOCK - 1)), axis=1)[:, int(percentile * (BLOCK - 1))].astype(np.int64)
    odd = bits > width[:, None]
    count = odd.sum(1)
    sizes = 7 + 32 * width + 5 * count
    starts = np.zeros(n, np.int64)
    np.cumsum(sizes[:-1], out=starts[1:])
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros((n, 7), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4] = width
    head[:, 5:] = count.astype("<u2").view(np.uint8).reshape(n, 2)
    out[starts[:, None] + np.arange(7)] = head
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        part = v[rows]
        planes = np.concatenate([np.packbits((part >> np.uint32(b)).astype(np.uint8) & 1, axis=1, bitorder="little") for b in range(w)], axis=1)
        out[(starts[rows] + 7)[:, None] + np.arange(32 * w)] = planes
    row, col = np.nonzero(odd)
    if len(row):
        nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        at = (starts + 7 + 32 * width)[row]
        out[at + nth] = col
        out[(at + count[row] + 4 * nth)[:, None] + np.arange(4)] = v[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, starts.astype(np.uint64)


def unpack(data: np.ndarray, starts: np.ndarray, total: int) -> np.ndarray:
    """What :func:`pack` packed."""
    n, starts = len(starts), starts.astype(np.int64)
    if not n:
        return np.zeros(0, np.uint32)
    head = data[starts[:, None] + np.arange(7)]
    least = head[:, :4].copy().view("<u4").ravel()
    width, count = head[:, 4].astype(np.int64), head[:, 5:].copy().view("<u2").ravel().astype(np.int64)
    v = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        planes = data[(starts[rows] + 7)[:, None] + np.arange(32 * w)].reshape(len(rows), w, 32)
        part = np.zeros((len(rows), BLOCK), np.uint32)
        for b in range(w):
            part |= np.unpackbits(planes[:, b], axis=1, bitorder="little").astype(np.uint32) << np.uint32(b)
        v[rows] = part
    if count.sum():
        row = np.repeat(np.arange(n), count)
        nth = np.arange(len(row)) - (np.cumsum(count) - count)[row]
        at = (starts + 7 + 32 * width)[row]
        v[row, data[at + nth]] = data[(at + count[row] + 4 * nth)[:, None] + np.arange(4)].view("<u4").ravel()
    return (v + least[:, None]).ravel()[:total]


def to_file(doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """A file's bytes from each document's ids."""
    values = np.frombuffer(b"".join(ids), "<u4")
    data, starts = pack(values)
    null = np.array([d is None for d in doc_ids], np.uint8)
    head = _HEAD.pack(_MAGIC, len(ids), len(values), len(starts), len(data))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), null.tobytes(), np.array([len(x) // 4 for x in ids], "<u8").tobytes(), starts.astype("<u8").tobytes(), data.tobytes()])


def from_file(content: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document's id and token ids from a file's bytes."""
    magic, docs, total, blocks, size = _HEAD.unpack_from(content)
    if magic != _MAGIC:
        raise ValueError("not a token file")
    at = _HEAD.size
    doc_ids = np.frombuffer(content, "<i8", docs, at)
    null = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(content, "<u8", docs, at + 9 * docs).astype(np.int64)
    starts = np.frombuffer(content, "<u8", blocks, at + 17 * docs)
    values = unpack(np.frombuffer(content, np.uint8, size, at + 17 * docs + 8 * blocks), starts, total)
    end = np.cumsum(lengths)
    for i in range(docs):
        yield None if null[i] else int(doc_ids[i]), values[end[i] - lengths[i] : end[i]]


def files(docs: DataFrame, tokenizer: str, end_id: int | None = 0, most_ids: int = 1 << 19) -> DataFrame:
    """Token files of ``docs`` (doc_id, text) in ascending doc_id: part, seq, before (ids before it in its part), n_ids, content."""
    dealt = docs.select("doc_id", "text").repartitionByRange(spread(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    schema = "part int, seq int, before long, n_ids long, content binary"

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = ChunkEncoder.of(tokenizer), TaskContext.get().partitionId()
        names, held, size, seq, before = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal names, held, size, seq, before
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([size], pa.int64()), "content": pa.array([to_file(names, held)], pa.binary())})
            names, held, seq, before, size = [], [], seq + 1, before + size, 0
            return out

        for batch in batches:
            docs_ids = batch.column(0).to_pylist()
            for a, e, ids, at in encoder.chunks(batch.column(1)):
                for i in range(a, e):
                    names.append(docs_ids[i])
                    held.append(ids[at[i - a] : at[i - a + 1]].tobytes() + end)
                    size += len(held[-1]) // 4
                    if size >= most_ids:
                        yield flush()
        if held:
            yield flush()

    return dealt.mapInArrow(tidied(write, keep_tables=True), schema)


def documents(written: DataFrame) -> DataFrame:
    """From a table of files that :func:`files` made: doc_id, start, n_tokens, ids_crc32 of each document.

    ``start`` counts the ids of all documents before it; the driver holds one number for each part.
    """
    sizes = {r[0]: r[1] for r in written.groupBy("part").agg(F.sum("n_ids")).collect()}
    base, done = {}, 0
    for part in sorted(sizes):
        base[part], done = done, done + sizes[part]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            at = base[batch.column(0)[0].as_py()] + batch.column(1)[0].as_py()
            rows = []
            for doc, ids in from_file(batch.column(2)[0].as_py()):
                rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return written.select("part", "before", "content").mapInArrow(tidied(read, keep_tables=True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(written: DataFrame, folder: str) -> None:
    """The files as plain ones in a folder that driver and executors share; each appears whole or not at all."""

    def save(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            part, seq, content = (batch.column(k)[0].as_py() for k in range(3))
            name = os.path.join(folder, f"part-{part:05d}-{seq:05d}.pfr")
            with open(f"{name}.{os.getpid()}", "wb") as f:
                f.write(content)
            os.replace(f.name, name)
            yield pa.RecordBatch.from_pydict({"name": [name]})

    os.makedirs(folder, exist_ok=True)
    written.select("part", "seq", "content").mapInArrow(tidied(save, keep_tables=True), "name string").count()
