"""Subsets of recordings as new ones: channels and block ranges, renumbered.

Ids are given in order of first need, starting where the format starts. Ids of different
files never meet, for they are keyed by file. A base channel and whatever its channels
refer to come along whole.
"""

from __future__ import annotations


from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockstrata.errors import InvalidData
from blockstrata.operators.groups import written_size
from blockstrata.sources.recording import Recording
from blockstrata.sources.writer import Writer
from blockstrata.sources.xml import Node

#: Fixed values of the format: which attribute of which element (any for *) holds an id of which kind.
REMAPPED = {("ch", "id"): "ch", ("ch", "base"): "ch", ("ch", "group"): "group", ("dim", "group"): "group", ("test", "id"): "test", ("test", "base"): "test", ("decoder", "id"): "decoder", ("data", "decoder"): "decoder", ("tag", "group"): "group", ("xform", "index_ch"): "ch"}


@dataclass
class Sifter:
    """Collects channels, then writes them by a Writer."""

    writer: Writer
    ids: dict[tuple[str, object, int], int] = field(default_factory=dict)
    signatures: dict[tuple[str, object], int] = field(default_factory=dict)
    ranges: dict[tuple[object, int], tuple[int, int]] = field(default_factory=dict)
    done: set[tuple[object, str, int]] = field(default_factory=set)
    sources: dict[object, Recording] = field(default_factory=dict)

    def find_id(self, kind: str, file: object, old: int) -> int | None:
        return self.ids.get((kind, file, old))

    def set_id(self, kind: str, file: object, old: int, new: int) -> None:
        self.ids[kind, file, old] = new

    def map_id(self, kind: str, file: object, old: int) -> int:
        key = (kind, file, old)
        if key not in self.ids:
            self.ids[key] = self.writer.next_id(kind)
        return self.ids[key]

    def find_id_by_signature(self, kind: str, signature: object) -> int | None:
        return self.signatures.get((kind, signature))

    def map_id_by_signature(self, kind: str, signature: object) -> int:
        """One id for all tests or decoders of a signature (``Program.signature``), whatever their files and ids; ``add`` itself goes by file and id."""
        key = (kind, signature)
        if key not in self.signatures:
            self.signatures[key] = self.writer.next_id(kind)
        return self.signatures[key]

    def map_group(self, file: object, old: int, start: int, end: int) -> int:
        """A group's new id; the range of its blocks grows to hold every one asked for."""
        low, high = self.ranges.get((file, old), (start, end))
        self.ranges[file, old] = (min(low, start), max(high, end))
        return self.map_id("group", file, old)

    def total_entries(self) -> int:
        return len(self.ids) + len(self.signatures)

    def add(self, recording: Recording, channel: int, start: int = 0, end: int | None = None) -> None:
        """A channel's blocks ``start`` to ``end``, and its definition; a second time only widens the range."""
        file = recording.path or id(recording)
        self.sources[file] = recording
        definitions = recording.catalog.definitions
        node = definitions.definition("ch", channel)
        if node is None:
            raise InvalidData(f"no channel {channel}")
        if "base" in node.attrs:
            self.add(recording, int(node.attrs["base"]))
        test = node.parent if node.parent is not None and node.parent.name == "test" else None
        for n in node.walk():
            for attr in ("group",):
                if n.kind == "element" and n.attrs.get(attr, "").isdigit():
                    group = int(n.attrs[attr])
                    whole = recording.num_blocks(group)
                    own = n is node or n.name == "dim"
                    self.map_group(file, group, *((start, whole if end is None else min(end, whole)) if own else (0, whole)))
            if n.kind == "element" and n.name == "data" and n.attrs.get("decoder", "").isdigit():
                self._define(file, definitions.definition("decoder", n.attrs["decoder"]), "decoder")
            if n.kind == "element" and n.name == "xform" and n.attrs.get("index_ch", "").isdigit():
                self.add(recording, int(n.attrs["index_ch"]))
        if (file, "ch", channel) in self.done:
            return
        self.done.add((file, "ch", channel))
        if test is not None and (ident := test.attrs.get("id", "")).isdigit():
            shell = Node("test", test.attrs)
            if (file, "test", int(ident)) not in self.done:
                self.done.add((file, "test", int(ident)))
                for c in test.elements("tag"):
                    if c.attrs.get("group", "").isdigit():
                        group = int(c.attrs["group"])
                        self.map_group(file, group, 0, recording.num_blocks(group))
                    shell.append(c.clone())
            shell.append(node.clone())
            self.writer.xml_node(self.remapped(file, shell))
        else:
            self.writer.xml_node(self.remapped(file, node.clone()))

    def _define(self, file: object, node: Node | None, kind: str) -> None:
        if node is not None and (file, kind, int(node.attrs["id"])) not in self.done:
            self.done.add((file, kind, int(node.attrs["id"])))
            self.map_id(kind, file, int(node.attrs["id"]))
            self.writer.xml_node(self.remapped(file, node.clone()))

    def remapped(self, file: object, node: Node) -> Node:
        """With new ids where the old ones have any."""
        for n in node.walk():
            for (name, attr), kind in REMAPPED.items():
                if n.kind == "element" and n.name == name and n.attrs.get(attr, "").isdigit():
                    old = int(n.attrs[attr])
                    new = self.map_id(kind, file, old) if attr in ("id",) or kind in ("ch", "test") else self.find_id(kind, file, old)
                    if new is not None:
                        n.attrs[attr] = str(new)
        return node

    def blocks(self) -> list[tuple[object, int, int, int, int]]:
        """(file, old group, new group, first block, end block) in the order of new groups."""
        out = [(f, g, self.ids["group", f, g], *r) for (f, g), r in self.ranges.items()]
        return sorted(out, key=lambda x: x[2])

    def total_size(self) -> int:
        """Bytes that the whole output will have once it is finished and closed."""
        payload = blocks = 0
        for file, old, _, start, end in self.blocks():
            entries = self.sources[file].groups.get(old, [])[start:end]
            payload, blocks = payload + sum(e.payload_size for e in entries), blocks + len(entries)
        return self.writer.total_size(payload, blocks)

    def finish(self) -> None:
        """Write the metadata, then the blocks under their new groups."""
        self.writer.flush_xml()
        for file, old, new, start, end in self.blocks():
            recording = self.sources[file]
            for e in recording.groups.get(old, [])[start:end]:
                self.writer.write_block(new, recording.payload(e))


def sift_file(path: str, out: str, channels: list[tuple[int, int, int | None]], **options: bool) -> int:
    """A new file with (channel, first block, end block) of another; returns its size."""
    with Recording(path) as recording, open(out, "wb") as f, Writer(f.write, **options) as writer:
        writer.xml_header()
        sifter = Sifter(writer)
        for channel, start, end in channels:
            sifter.add(recording, channel, start, end)
        sifter.finish()
    return writer.offset


# ---- the same over tables of blocks ----


def id_map(wanted: DataFrame, key: str, order: str, first: int) -> DataFrame:
    """(key, new): ids in order of first appearance."""
    seen = wanted.groupBy(key).agg(F.min(order).alias("_first"))
    return seen.select(key, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first", key)) - 1 + first).cast("long").alias("new"))


def group_ranges(wanted: DataFrame) -> DataFrame:
    """(group, start, end): ranges of one group widened to one."""
    return wanted.groupBy("group").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def sift_blocks(blocks: DataFrame, wanted: DataFrame, first: int = 2) -> DataFrame:
    """Blocks (group, block, payload) that ``wanted`` (ord, group, start, end) asks for, as (group, old_group, block, payload), numbered anew."""
    ranges = group_ranges(wanted).join(id_map(wanted, "group", "ord", first), "group")
    kept = blocks.join(ranges, "group").where((F.col("block") >= F.col("start")) & (F.col("block") < F.col("end")))
    return kept.select(F.col("new").alias("group"), F.col("group").alias("old_group"), (F.col("block") - F.col("start")).alias("block"), "payload")


def remap(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """A column of ids with new ones (old, new) where there are any; others stay."""
    joined = rows.join(ids.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(column) == F.col("_old"), "left")
    return joined.withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def sifted_size(blocks: DataFrame, wanted: DataFrame, index: bool = True) -> DataFrame:
    """One row: what a file with the wanted blocks takes."""
    return written_size(sift_blocks(blocks, wanted), index)


