"""Blocks in bytes: framing, checksums, index blocks, scanning forwards, backwards and past damage.

A block is: size, group, sync word (big-endian 32-bit words), payload, CRC-32 of all that,
size again. ``legacy`` framing has the payload's size first, the sync word last, and a CRC
of the payload alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import numpy as np

from blockstrata.errors import InvalidBlock

#: Fixed values of the format.
SYNC = bytes([0x51, 0xED, 0xA7, 0xA0])
XML_GROUP, INDEX_GROUP = 0, 1
OVERHEAD = 20
_HEAD, _TAIL = struct.Struct(">II4s"), struct.Struct(">II")
_INDEX = np.dtype([("offset", ">u8"), ("group", ">u4")])


class Entry(NamedTuple):
    """Where a block lies."""

    offset: int
    size: int
    group: int

    @property
    def payload_size(self) -> int:
        return self.size - OVERHEAD


class Block(NamedTuple):
    group: int
    payload: bytes
    crc: int
    crc_ok: bool
    offset: int = 0
    size: int = 0


def encode(group: int, payload: bytes, legacy: bool = False, checksum: bool = True, crc: int | None = None) -> bytes:
    """A block's bytes; ``crc`` stands in the trailer as it is, right or wrong, if given."""
    if legacy:
        return _HEAD.pack(len(payload), group, SYNC) + payload + struct.pack(">I4s", zlib.crc32(payload) if checksum else 0, SYNC)
    body = _HEAD.pack(len(payload) + OVERHEAD, group, SYNC) + payload
    return body + _TAIL.pack(crc if crc is not None else zlib.crc32(body) if checksum else 0, len(payload) + OVERHEAD)


def decode(data: bytes, at: int = 0, verify: bool = False) -> Block:
    """The block that begins at ``at``; a CRC of zero stands for none."""
    if at < 0 or at + OVERHEAD > len(data):
        raise InvalidBlock(f"no block at {at}")
    size, group, sync = _HEAD.unpack_from(data, at)
    if sync != SYNC or size < OVERHEAD or at + size > len(data):
        raise InvalidBlock(f"no block at {at}")
    crc, again = _TAIL.unpack_from(data, at + size - 8)
    if again != size:
        raise InvalidBlock(f"sizes differ at {at}")
    ok = crc in (0, zlib.crc32(memoryview(data)[at : at + size - 8]))
    if verify and not ok:
        raise InvalidBlock(f"checksum differs at {at}")
    return Block(group, bytes(data[at + 12 : at + size - 8]), crc, ok, at, size)


def decode_legacy(data: bytes, at: int = 0) -> Block:
    if at < 0 or at + OVERHEAD > len(data):
        raise InvalidBlock(f"no block at {at}")
    size, group, sync = _HEAD.unpack_from(data, at)
    if sync != SYNC or at + OVERHEAD + size > len(data):
        raise InvalidBlock(f"no block at {at}")
    crc, last = struct.unpack_from(">I4s", data, at + 12 + size)
    if last != SYNC:
        raise InvalidBlock(f"no trailer at {at}")
    payload = bytes(data[at + 12 : at + 12 + size])
    return Block(group, payload, crc, crc in (0, zlib.crc32(payload)), at, size + OVERHEAD)


def index_payload(entries: Iterable[tuple[int, int]]) -> bytes:
    """(offset, group) pairs as an index block's payload."""
    return np.array(list(entries), _INDEX).tobytes() if (entries := list(entries)) else b""


def read_index(payload: bytes, end: int) -> list[Entry]:
    """The blocks that an index block at ``end`` covers; each reaches to the next one's offset."""
    if len(payload) % _INDEX.itemsize:
        raise InvalidBlock("index of odd length")
    pairs = np.frombuffer(payload, _INDEX)
    offsets = pairs["offset"].astype(np.int64)
    sizes = np.diff(np.append(offsets, end))
    if (sizes < OVERHEAD).any():
        raise InvalidBlock("index offsets do not rise")
    return [Entry(int(o), int(s), int(g)) for o, s, g in zip(offsets, sizes, pairs["group"], strict=True)]


class BlockFile:
    """Random access to the blocks of a seekable file."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        self.size = file.seek(0, 2)

    def read_at(self, offset: int, verify: bool = False) -> Block:
        """The block at an offset; its checksum is looked at only if asked."""
        if offset < 0 or offset + OVERHEAD > self.size:
            raise InvalidBlock(f"no block at {offset}")
        self.file.seek(offset)
        head = self.file.read(12)
        size, _, sync = _HEAD.unpack(head)
        if sync != SYNC or size < OVERHEAD or offset + size > self.size:
            raise InvalidBlock(f"no block at {offset}")
        return decode(head + self.file.read(size - 12), 0, verify)._replace(offset=offset)

    def entry_at(self, offset: int) -> Entry:
        """Header and trailer only."""
        if offset < 0 or offset + OVERHEAD > self.size:
            raise InvalidBlock(f"no block at {offset}")
        self.file.seek(offset)
        size, group, sync = _HEAD.unpack(self.file.read(12))
        if sync != SYNC or size < OVERHEAD or offset + size > self.size:
            raise InvalidBlock(f"no block at {offset}")
        self.file.seek(offset + size - 4)
        if struct.unpack(">I", self.file.read(4))[0] != size:
            raise InvalidBlock(f"sizes differ at {offset}")
        return Entry(offset, size, group)

    def entry_before(self, end: int) -> Entry:
        """The block that ends at ``end``, found by the size in its trailer."""
        if end < OVERHEAD:
            raise InvalidBlock(f"no block before {end}")
        self.file.seek(end - 4)
        size = struct.unpack(">I", self.file.read(4))[0]
        if size > end:
            raise InvalidBlock(f"no block before {end}")
        return self.entry_at(end - size)

    def is_recording(self) -> bool:
        """Whether the sync word stands where the first block has it."""
        self.file.seek(8)
        return self.file.read(4) == SYNC

    def last_sync(self, most: int | None = None, step: int = 1 << 16) -> int | None:
        """The offset of the last sync word in the file's last ``most`` bytes."""
        low = max(0, self.size - most) if most is not None else 0
        end = self.size
        while end > low:
            start = max(low, end - step)
            self.file.seek(start)
            found = self.file.read(min(self.size, end + 3) - start).rfind(SYNC)
            if found >= 0:
                return start + found
            end = start
        return None

    def last_block(self, most: int | None = None) -> Entry | None:
        """The last whole block, whatever garbage follows it."""
        end = most
        limit = self.size
        while (at := BlockFileView(self, limit).last_sync(end)) is not None:
            try:
                return self.entry_at(at - 8)
            except InvalidBlock:
                limit = at + 3
                end = None if most is None else max(0, most - (self.size - limit))
        return None

    def forward(self, start: int = 0) -> Iterator[Entry]:
        """Blocks one behind the other, up to the end or the first that is none."""
        at = start
        while at < self.size:
            try:
                entry = self.entry_at(at)
            except InvalidBlock:
                return
            yield entry
            at += entry.size

    def backward(self) -> list[Entry]:
        """All blocks from the end, with one read for each index block and for each block that none covers."""
        out: list[Entry] = []
        end = self.size
        while end > 0:
            try:
                entry = self.entry_before(end)
            except InvalidBlock:
                break
            out.append(entry)
            end = entry.offset
            if entry.group == INDEX_GROUP:
                covered = read_index(self.read_at(entry.offset).payload, entry.offset)
                out.extend(reversed(covered))
                if covered:
                    end = covered[0].offset
        return out[::-1]

    def index(self) -> list[Entry]:
        """All blocks in file order: backwards by index blocks, or forwards where that fails or stops early."""
        try:
            found = self.backward()
        except InvalidBlock:
            found = []
        return found or list(self.forward())

    def unindexed(self) -> list[Entry]:
        """Blocks behind the last index block; all where there is none."""
        entries = self.index()
        last = max((i for i, e in enumerate(entries) if e.group == INDEX_GROUP), default=-1)
        return entries[last + 1 :]


class BlockFileView(BlockFile):
    """The first ``size`` bytes of another."""

    def __init__(self, whole: BlockFile, size: int) -> None:
        self.file, self.size = whole.file, size


def resync(data: bytes, start: int, end: int, final: bool = True) -> tuple[list[Block], int]:
    """Whole blocks whose headers begin in [start, end), sliding byte by byte past what is none, and where to go on."""
    out, at = [], start
    while at < end:
        try:
            block = decode(data, at)
        except InvalidBlock:
            found = data.find(SYNC, at + 9)
            head = data[at : at + 12]
            if not final and len(head) == 12 and head[8:] == SYNC and int.from_bytes(head[:4], "big") >= OVERHEAD and at + int.from_bytes(head[:4], "big") > len(data):
                return out, at  # the rest may still come
            at = found - 8 if found >= 0 else max(at + 1, len(data) - 11)
            continue
        out.append(block)
        at += block.size
    return out, at


class StreamParser:
    """Blocks out of chunks of bytes as they come; chunks may be cut anywhere."""

    def __init__(self, legacy: bool = False) -> None:
        self.legacy, self.held, self.base = legacy, b"", 0

    def feed(self, chunk: bytes) -> list[Block]:
        self.held += chunk
        out, at = [], 0
        while at + 12 <= len(self.held):
            size, _, sync = _HEAD.unpack_from(self.held, at)
            total = size + (OVERHEAD if self.legacy else 0)
            if sync != SYNC or total < OVERHEAD:
                found = self.held.find(SYNC, at + 9)
                at = found - 8 if found >= 0 else max(at + 1, len(self.held) - 11)
                continue
            if at + total > len(self.held):
                break
            try:
                block = (decode_legacy if self.legacy else decode)(self.held, at)
            except InvalidBlock:
                at += 1
                continue
            out.append(block._replace(offset=self.base + at))
            at += total
        self.held, self.base = self.held[at:], self.base + at
        return out
