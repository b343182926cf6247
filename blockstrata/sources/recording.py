"""One recording on the driver: its index and catalog, and the rows of a channel block by block.

This is what plans a read (datasource.py) and what serves a caller who wants one file
without Spark. Only headers and metadata are read here; data are read where they are used.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa

from blockstrata.errors import InvalidBlock, InvalidData
from blockstrata.sources.catalog import Catalog, Channel
from blockstrata.sources.decoding import Decoder, decoded
from blockstrata.sources.framing import INDEX_GROUP, XML_GROUP, Block, BlockFile, Entry


class Recording:
    """An open file: ``entries`` in file order, ``groups`` (block entries by group), ``catalog``."""

    def __init__(self, path: str | None = None, file: BinaryIO | None = None, mode: str = "reference") -> None:
        self.path = path
        self.file = BlockFile(file if file is not None else open(path, "rb"))  # noqa: SIM115
        if not self.file.is_recording():
            raise InvalidBlock(f"{path} is no recording")
        self.entries: list[Entry] = self.file.index()
        self.groups: dict[int, list[Entry]] = {}
        for e in self.entries:
            self.groups.setdefault(e.group, []).append(e)
        self.catalog = Catalog.of((self.payload(e) for e in self.groups.get(XML_GROUP, [])), mode)

    def payload(self, entry: Entry, verify: bool = False) -> bytes:
        return self.file.read_at(entry.offset, verify).payload

    def block(self, group: int, nth: int, verify: bool = False) -> Block:
        return self.file.read_at(self.groups[group][nth].offset, verify)

    def num_blocks(self, group: int) -> int:
        return len(self.groups.get(group, []))

    def num_bytes(self, group: int) -> int:
        return sum(e.payload_size for e in self.groups.get(group, []))

    def highest_group(self) -> int:
        return max(self.groups, default=0)

    def tag_value(self, group: int) -> bytes:
        """The value of a tag that is kept in a group of its own."""
        return b"".join(self.payload(e) for e in self.groups.get(group, []))

    def rows(self, channel: Channel, start: int = 0, end: int | None = None, vectorised: bool = True) -> Iterator[pa.RecordBatch]:
        """Decoded, untransformed rows of blocks ``start`` to ``end`` of a channel."""
        group, program, columns = self.catalog.binding(channel)
        decoder = Decoder(program, vectorised)
        for n, e in list(enumerate(self.groups.get(group, [])))[start:end]:
            rows = decoded(decoder, columns, n, self.payload(e))
            if rows is not None:
                yield rows

    def bound(self, channel: Channel, dim: int, x: float, upper: bool, value: Callable[[float], float] = float) -> tuple[int, int] | None:
        """(block, scan) of the first row whose ``value`` is at or above x, or with ``upper`` of the last at or below it, in a dimension that does not fall.

        Blocks are halved by their last (first) value, so about log2 of them are read; empty ones are stepped over.
        """
        at = [i for i, d in enumerate(channel.dims) if d.index == dim]
        if not at:
            raise InvalidData(f"no dimension {dim}")
        group, program, columns = self.catalog.binding(channel)
        if columns[at[0]] is None or program.raw[columns[at[0]]]:
            raise InvalidData(f"dimension {dim} has no numbers")
        decoder, entries, held = Decoder(program), self.groups.get(group, []), {}

        def values(block: int) -> list[float]:
            if block not in held:
                rows = decoded(decoder, columns, block, self.payload(entries[block]))
                held[block] = [] if rows is None else [value(v) for v in rows.column(2 + at[0]).to_pylist()]
            return held[block]

        def reaches(block: int) -> bool:
            """Whether the bound lies in this block or, for the lower one, before it; for the upper one, behind it."""
            own = values(block)
            return bool(own) and (own[0] <= x if upper else own[-1] >= x)

        low, high = 0, len(entries)
        while low < high:
            middle = probe = (low + high) // 2
            while probe < high and not values(probe):
                probe += 1
            if probe == high:
                high = middle
            elif reaches(probe) != upper:
                high = middle
            else:
                low = probe + 1
        blocks = range(low - 1, -1, -1) if upper else range(low, len(entries))
        for block in blocks:
            rows = [i for i, v in enumerate(values(block)) if (v <= x if upper else v >= x)]
            if rows:
                return block, rows[-1] if upper else rows[0]
        return None

    def data_groups(self) -> list[int]:
        return sorted(g for g in self.groups if g not in (XML_GROUP, INDEX_GROUP))

    def close(self) -> None:
        self.file.file.close()

    def __enter__(self) -> Recording:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
