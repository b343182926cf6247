"""Writing recordings: blocks, buffered XML and index blocks, ids, and the size of what will be written."""

from __future__ import annotations

from collections.abc import Callable
from typing import BinaryIO

from blockstrata.sources.framing import INDEX_GROUP, OVERHEAD, XML_GROUP, Block, StreamParser, encode, index_payload
from blockstrata.sources.xml import Node

#: Fixed values of the format: buffers are flushed beyond this size; the first ids of each kind; the preamble.
FLUSH = 65536
INDEX_ENTRY = 12
FIRST_IDS = {"group": 2, "decoder": 2, "test": 0, "ch": 0}
SYNC_TEXT = "0x51EDA7A0"


def header(namespace: str | None = None) -> str:
    """The preamble that describes the format in its own terms; readers that ask for a namespace get it here."""
    sie = Node("sie", {"version": "1.0"} | ({"xmlns": namespace} if namespace else {}))
    read = lambda var, **a: Node("read", {"var": var, **a})
    word = {"bits": "32", "type": "uint", "endian": "big"}
    stream = sie.append(Node("decoder", {"id": "0"})).append(Node("loop"))
    for node in (read("size", **word), read("group", **word), read("syncword", **word, value=SYNC_TEXT), read("payload", octets="{$size - 20}", type="raw"), read("checksum", **word), read("size2", **word, value="{$size}")):
        stream.append(node)
    sie.append(Node("tag", {"id": "sie:xml_metadata", "group": "0", "format": "text/xml"}))
    index = sie.append(Node("decoder", {"id": "1"})).append(Node("loop"))
    for node in (read("v0", bits="64", type="uint", endian="big"), read("v1", **word), Node("sample")):
        index.append(node)
    sie.append(Node("tag", {"id": "sie:block_index", "group": "1", "decoder": "1"}))
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + sie.to_xml().replace("</sie>\n", "")


class Writer:
    """Calls ``sink`` with bytes. Index blocks cover what was written since the last one; with ``flush`` None they are written only when asked for and at the end."""

    def __init__(self, sink: Callable[[bytes], object], index: bool = True, checksum: bool = True, flush: int | None = FLUSH) -> None:
        self.sink, self.index, self.checksum, self.flush = sink, index, checksum, flush
        self.offset = 0
        self.xml = b""
        self.entries: list[tuple[int, int]] = []
        self.ids = dict(FIRST_IDS)

    def write_block(self, group: int, payload: bytes) -> int:
        """Write a block; returns its offset."""
        at, data = self.offset, encode(group, payload, checksum=self.checksum)
        self.sink(data)
        self.offset += len(data)
        if self.index and group != INDEX_GROUP:
            self.entries.append((at, group))
            if self.flush is not None and len(self.entries) * INDEX_ENTRY > self.flush:
                self.flush_index()
        return at

    def xml_string(self, text: str) -> None:
        self.xml += text.encode()
        if len(self.xml) > FLUSH:
            self.flush_xml()

    def xml_node(self, node: Node) -> None:
        self.xml_string(node.to_xml())

    def xml_header(self) -> None:
        self.xml_string(header())

    def flush_xml(self) -> None:
        if self.xml:
            data, self.xml = self.xml, b""
            self.write_block(XML_GROUP, data)

    def flush_index(self) -> None:
        if self.entries:
            entries, self.entries = self.entries, []
            self.write_block(INDEX_GROUP, index_payload(entries))

    def next_id(self, kind: str) -> int:
        self.ids[kind] += 1
        return self.ids[kind] - 1

    def total_size(self, payload_bytes: int = 0, blocks: int = 0) -> int:
        """Bytes of the whole output if ``blocks`` more blocks of so many payload bytes are written and then it is closed."""
        if self.xml:
            payload_bytes, blocks = payload_bytes + len(self.xml), blocks + 1
        size = self.offset + payload_bytes + OVERHEAD * blocks
        return size + index_bytes(len(self.entries) + blocks if self.index else 0, self.flush)

    def close(self) -> None:
        self.flush_xml()
        self.flush_index()

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def index_bytes(blocks: int, flush: int | None = FLUSH) -> int:
    """What the index of so many blocks takes, in blocks of its own."""
    per_block = flush // INDEX_ENTRY + 1 if flush is not None else max(1, blocks)
    return blocks * INDEX_ENTRY + -(-blocks // per_block) * OVERHEAD


class FileStream:
    """Bytes come in chunks cut anywhere; whole blocks go to a file as they came, checksums right or wrong, and are counted by group."""

    def __init__(self, path: str | None = None, on_xml: Callable[[str], object] | None = None, legacy: bool = False, file: BinaryIO | None = None) -> None:
        self.file = file if file is not None else open(path, "wb+")  # noqa: SIM115
        self.parser, self.on_xml = StreamParser(legacy), on_xml
        self.groups: dict[int, list[tuple[int, int]]] = {}
        self.closed: set[int] = set()
        self.size = 0

    def add(self, data: bytes) -> int:
        """Take a chunk; always all of it."""
        for block in self.parser.feed(data):
            self._write(block)
        return len(data)

    def _write(self, block: Block) -> None:
        data = encode(block.group, block.payload, crc=block.crc)
        self.file.write(data)
        self.groups.setdefault(block.group, []).append((self.size, len(block.payload)))
        self.size += len(data)
        if not block.payload:
            self.closed.add(block.group)
        if block.group == XML_GROUP and self.on_xml:
            self.on_xml(block.payload.decode("utf-8", "replace"))

    def num_groups(self) -> int:
        return len(self.groups)

    def highest_group(self) -> int:
        return max(self.groups, default=0)

    def is_group_closed(self, group: int) -> bool:
        """Whether an empty block has ended the group."""
        return group in self.closed

    def read_block(self, group: int, nth: int) -> bytes:
        offset, size = self.groups[group][nth]
        self.file.seek(offset + 12)
        data = self.file.read(size)
        self.file.seek(0, 2)
        return data

    def close(self) -> None:
        self.file.close()
