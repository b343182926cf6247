"""Recordings as a Spark data source: ``spark.read.format("recording")``, ``.write`` and ``.readStream``.

Read options: ``path`` (a file, a folder or a pattern), ``table`` (blocks, samples, index,
tests, channels, dims, tags or decoders), ``channel`` and ``dims`` for samples, ``mode``
(catalog), ``verify`` (checksums), ``partition_bytes``, ``split``, ``group`` (one or more, by
commas), ``from_block`` and ``to_block`` (by number in the group, both included). The driver reads headers
and metadata; a partition is a run of blocks of about ``partition_bytes``, read where it runs,
and only the groups and blocks that the options ask for; it carries the program, so tasks read no metadata.
What is to be read is said by options and not by pushed filters, for Spark keeps what a Python source has
pruned with the relation: a frame filtered once would stay pruned in all its later uses. With ``split`` set to true the driver
looks at file sizes alone: a partition is a range of bytes, which finds its first block by
itself and owns the blocks that begin in it; blocks then have offsets but no numbers. Writing takes (group, payload) rows,
one file a task, each with its index, whole or not at all. Streaming follows the files of a
folder as they grow, by whole blocks.
"""

from __future__ import annotations

import glob
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from blockstrata.errors import InvalidBlock, InvalidData
from blockstrata.sources.catalog import Catalog, Channel
from blockstrata.sources.decoding import Decoder, decoded, sample_schema
from blockstrata.sources.framing import OVERHEAD, SYNC, Block, BlockFile, BlockFileView
from blockstrata.sources.recording import Recording
from blockstrata.sources.writer import Writer

BLOCKS = "file string, block_seq long, offset long, size long, group long, block long, payload_size long, payload binary, crc long, crc_ok boolean"
SCHEMAS = {
    "blocks": BLOCKS,
    "index": "file string, block_seq long, offset long, size long, group long, block long, payload_size long",
    "tests": "file string, test_id long, name string",
    "channels": "file string, channel_id long, test_id long, name string, group_id long, base_id long",
    "dims": "file string, channel_id long, dim_index long, decoder_id long, v long, xform struct<kind:string,scale:double,offset:double,table:array<double>,index_channel:long,index_dim:long>",
    "tags": "file string, owner_kind string, owner_id long, dim_index long, ord long, key string, value string, group_id long, format string",
    "decoders": "file string, decoder_id long, signature long, columns long, listing string, error string",
}


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(p for p in glob.glob(os.path.join(path, "**"), recursive=True) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


@dataclass
class Run(InputPartition):
    """Blocks of a file: (number in the file, offset, number in the group); for samples what they are decoded by."""

    def __init__(self, file: str, blocks: list[tuple[int, int, int]], binding: tuple[Any, list[int | None], list[int]] | None = None) -> None:
        super().__init__((file, blocks))
        self.file, self.blocks, self.binding = file, blocks, binding


class Range(InputPartition):
    """Blocks of a file whose headers begin in [low, high)."""

    def __init__(self, file: str, low: int, high: int) -> None:
        super().__init__((file, low, high))
        self.file, self.low, self.high = file, low, high


def blocks_in(file: BlockFile, low: int, high: int, step: int = 1 << 20) -> Iterator[Block]:
    """Whole blocks that begin in a range of bytes. Where one ends another is tried; else the next sync word is looked for."""
    at = low
    while at < high:
        try:
            block = file.read_at(at)
        except InvalidBlock:
            found = -1
            while found < 0 and at < high:
                file.file.seek(at + 9)
                data = file.file.read(min(step, high - at) + 3)
                found = data.find(SYNC)
                at = at + 1 + found if found >= 0 else at + max(1, len(data) - 3)
            if found < 0:
                return
            continue
        yield block
        at += block.size


class Recordings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    @property
    def table(self) -> str:
        return self.options.get("table", "samples" if "channel" in self.options else "blocks")

    @property
    def mode(self) -> str:
        return self.options.get("mode", "reference")

    def _channel(self, recording: Recording) -> Channel:
        channel = recording.catalog.channel(int(self.options["channel"]))
        if channel is None:
            raise InvalidData(f"no channel {self.options['channel']}")
        return channel

    def _columns(self, recording: Recording) -> tuple[int, Any, list[int | None], list[int]]:
        channel = self._channel(recording)
        group, program, columns = recording.catalog.binding(channel)
        keep = [int(x) for x in self.options["dims"].split(",")] if "dims" in self.options else list(range(len(columns)))
        return group, program, columns, keep

    def schema(self) -> str | StructType:
        if self.table != "samples":
            return SCHEMAS[self.table]
        with Recording(files_of(self.options["path"])[0], mode=self.mode) as recording:
            _, program, columns, keep = self._columns(recording)
        full = sample_schema(program, columns)
        return StructType([full["block"], full["scan"], *(full[f"dim{i}"] for i in keep)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options["path"], schema, overwrite, self.options.get("xml", ""), self.options.get("index", "true").lower() == "true")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return Tail(self.options["path"])


class Reader(DataSourceReader):
    def __init__(self, source: Recordings, schema: StructType) -> None:
        self.source, self.schema_ = source, schema
        self.options, self.table, self.mode = dict(source.options), source.table, source.mode
        self.groups: set[int] | None = {int(g) for g in self.options["group"].split(",")} if "group" in self.options else None
        self.first, self.last = int(self.options.get("from_block", 0)), int(self.options["to_block"]) if "to_block" in self.options else None

    def _wanted(self, nth: int) -> bool:
        return nth >= self.first and (self.last is None or nth <= self.last)

    def partitions(self) -> list[InputPartition]:
        most = int(self.options.get("partition_bytes", 64 << 20))
        out: list[InputPartition] = []
        for file in files_of(self.options["path"]):
            if self.table not in ("blocks", "samples"):
                out.append(Run(file, []))
                continue
            if self.table == "blocks" and self.options.get("split", "false").lower() == "true":
                size = os.path.getsize(file)
                out += [Range(file, low, min(size, low + most)) for low in range(0, size, most)]
                continue
            with Recording(file, mode=self.mode) as recording:
                groups, binding = self.groups, None
                if self.table == "samples":
                    group, *binding = self.source._columns(recording)
                    groups = {group}
                count: dict[int, int] = {}
                run, size = [], 0
                for seq, e in enumerate(recording.entries):
                    nth = count[e.group] = count.get(e.group, -1) + 1
                    if groups is not None and e.group not in groups or not self._wanted(nth):
                        continue
                    run.append((seq, e.offset, nth))
                    size += e.size
                    if size >= most:
                        out.append(Run(file, run, binding))
                        run, size = [], 0
                if run:
                    out.append(Run(file, run, binding))
        return out

    def read(self, partition: Run | Range) -> Iterator[pa.RecordBatch] | Iterator[tuple]:
        if partition is None:  # what Spark hands over where there is nothing to read
            return
        if isinstance(partition, Range):
            with open(partition.file, "rb") as f:
                for b in blocks_in(BlockFile(f), partition.low, partition.high):
                    if self.groups is None or b.group in self.groups:
                        yield partition.file, None, b.offset, b.size, b.group, None, len(b.payload), b.payload, b.crc, b.crc_ok
        elif self.table == "samples":
            yield from self._samples(partition)
        elif self.table == "blocks":
            verify = self.options.get("verify", "false").lower() == "true"
            with open(partition.file, "rb") as f:
                file = BlockFile(f)
                for seq, offset, nth in partition.blocks:
                    b = file.read_at(offset, verify)
                    yield partition.file, seq, offset, b.size, b.group, nth, len(b.payload), b.payload, b.crc, b.crc_ok
        else:
            with Recording(partition.file, mode=self.mode) as recording:
                yield from (tuple(r) for r in self._metadata(recording, partition.file))

    def _samples(self, partition: Run) -> Iterator[pa.RecordBatch]:
        program, columns, keep = partition.binding
        decoder = Decoder(program)
        with open(partition.file, "rb") as f:
            file = BlockFile(f)
            for _, offset, nth in partition.blocks:
                rows = decoded(decoder, columns, nth, file.read_at(offset).payload)
                if rows is not None:
                    yield rows.select(["block", "scan", *(f"dim{i}" for i in keep)])

    def _metadata(self, recording: Recording, file: str) -> Iterator[tuple]:
        catalog = recording.catalog
        if self.table == "index":
            count: dict[int, int] = {}
            for seq, e in enumerate(recording.entries):
                nth = count[e.group] = count.get(e.group, -1) + 1
                if self.groups is None or e.group in self.groups:
                    yield file, seq, e.offset, e.size, e.group, nth, e.size - OVERHEAD
        else:
            yield from metadata_rows(catalog, self.table, file)


def metadata_rows(catalog: Catalog, table: str, file: str | None = None) -> Iterator[tuple]:
    """Rows of a metadata table of a catalog."""
    if table == "tests":
        yield from ((file, t.id, t.name) for t in catalog.tests)
    elif table == "channels":
        yield from ((file, c.id, c.test, c.name, c.group, c.base) for c in catalog.channels)
    elif table == "dims":
        for c in catalog.channels:
            for d in c.dims:
                x = d.transform
                yield file, c.id, d.index, d.decoder, d.v, (x.kind, x.scale, x.offset, x.table, x.index_channel, x.index_dim)
    elif table == "decoders":
        for ident, p in catalog.decoders.items():
            yield file, ident, p.signature(), p.columns, p.explain(), None
        yield from ((file, ident, None, None, None, why) for ident, why in catalog.failed.items())
    elif table == "tags":
        owners = [("file", None, None, catalog.tags), *(("test", t.id, None, t.tags) for t in catalog.tests)]
        for c in catalog.channels:
            owners += [("channel", c.id, None, c.tags), *(("dim", c.id, d.index, d.tags) for d in c.dims)]
        for kind, owner, dim, tags in owners:
            yield from ((file, kind, owner, dim, n, t.key, t.value, t.group, t.format) for n, t in enumerate(tags))
    else:
        raise ValueError(f"table {table!r}")


@dataclass
class Written(WriterCommitMessage):
    temporary: str | None


class FileWriter(DataSourceWriter):
    """(group, payload) rows in order, one file a task; files appear when all tasks are done."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, xml: str, index: bool) -> None:
        self.path, self.names, self.overwrite, self.xml, self.index = path.removeprefix("file://"), schema.names, overwrite, xml, index
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator[Any]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"_{self.job}-{uuid.uuid4().hex}")
        some = False
        with open(name, "wb") as f, Writer(f.write, self.index) as writer:
            if self.xml:
                writer.xml_header()
                writer.xml_string(self.xml)
                writer.flush_xml()
                some = True
            for row in rows:
                writer.write_block(row["group"], bytes(row["payload"]))
                some = True
        if not some:
            os.remove(name)
        return Written(name if some else None)

    def commit(self, messages: list[Written]) -> None:
        """New files appear first; then, to overwrite, those that earlier jobs of this writer left go, and no others."""
        old = [p for p in glob.glob(os.path.join(self.path, "part-*.rec")) if re.fullmatch(r"part-\d{5,}-[0-9a-f]{32}\.rec", os.path.basename(p))] if self.overwrite else []
        for n, m in enumerate(x for x in messages if x and x.temporary):
            os.replace(m.temporary, os.path.join(self.path, f"part-{n:05d}-{self.job}.rec"))
        for p in old:
            os.remove(p)

    def abort(self, messages: list[Written]) -> None:
        for m in messages:
            if m and m.temporary and os.path.exists(m.temporary):
                os.remove(m.temporary)


def whole_until(file: BlockFile, start: int, stops: list[int] | None = None, step: int = 1 << 20, stretch: int = 64 << 20) -> int:
    """Where the last whole block behind ``start`` ends, past damage; a block that may still grow is waited for.

    Only headers and trailers are read, and what lies between damage and the next sync word. ``stops`` gets block
    boundaries about ``stretch`` bytes apart.
    """
    at = end = start
    while at + OVERHEAD <= file.size:
        try:
            entry = file.entry_at(at)
        except InvalidBlock:
            file.file.seek(at)
            head = file.file.read(12)
            if at == end and head[8:] == SYNC and int.from_bytes(head[:4], "big") >= OVERHEAD and at + int.from_bytes(head[:4], "big") > file.size:
                break
            file.file.seek(at + 9)
            found = file.file.read(step).find(SYNC)
            at = at + 1 + found if found >= 0 else at + max(1, step - 3)
            continue
        at = end = entry.offset + entry.size
        if stops is not None and end - (stops[-1] if stops else start) >= stretch:
            stops.append(end)
    return end


class Tail(DataSourceStreamReader):
    """New whole blocks of the files of a folder; the offset has, for each file, the end of the last whole block.

    Headers behind that end are walked once a batch, not the file from its start; after a restart the walk begins
    where the checkpoint says, as soon as a batch has been planned.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        for name in files_of(self.path):
            with open(name, "rb") as f:
                self.known[name] = whole_until(BlockFile(f), self.known.get(name, 0))
        return {"files": json.dumps(self.known)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for name, high in after.items():
            low, stops = before.get(name, 0), []
            self.known[name] = max(self.known.get(name, 0), high)
            if high > low:
                with open(name, "rb") as f:
                    whole_until(BlockFileView(BlockFile(f), high), low, stops)
                edges = [low, *(s for s in stops if s < high), high]
                out += [InputPartition((name, a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Blocks that begin in [from, to), which are whole."""
        name, low, high = partition.value
        with open(name, "rb") as f:
            for b in blocks_in(BlockFileView(BlockFile(f), high), low, high):
                yield name, None, b.offset, b.size, b.group, None, len(b.payload), b.payload, b.crc, b.crc_ok

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    """Make ``recording`` known to a session."""
    spark.dataSource.register(Recordings)


def read(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    register(spark)
    return spark.read.format("recording").options(path=path, **{k: str(v) for k, v in options.items()}).load()



