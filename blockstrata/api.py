"""One door to all of it: open, look around, read, search, reduce, subset, repair, write, follow."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from blockstrata import __version__
from blockstrata.errors import InvalidData, StrataError, status_message
from blockstrata.functions import text as _text
from blockstrata.operators import crush as _crush
from blockstrata.operators import histogram as _histogram
from blockstrata.operators import recover as _recover
from blockstrata.operators import rows as _rows
from blockstrata.operators import sift as _sift
from blockstrata.sources import datasource
from blockstrata.sources.catalog import Catalog, Channel, Tag, Test, find_tag
from blockstrata.sources.decoding import decode_blocks
from blockstrata.sources.recording import Recording
from blockstrata.sources.writer import FileStream, Writer

__all__ = ["File", "FileStream", "Recording", "StrataError", "Writer", "open_file", "recover", "sift", "status_message", "version"]


def version() -> str:
    return __version__


class File:
    """A recording in a Spark session. Metadata are at hand; data are DataFrames."""

    def __init__(self, spark: SparkSession, path: str, mode: str = "reference") -> None:
        self.spark, self.path, self.mode = spark, path, mode
        with Recording(path, mode=mode) as recording:
            self.catalog: Catalog = recording.catalog
        datasource.register(spark)

    def tests(self) -> list[Test]:
        return self.catalog.tests

    def channels(self) -> list[Channel]:
        return self.catalog.channels

    def tags(self) -> list[Tag]:
        return self.catalog.tags

    def tag(self, tags: list[Tag], key: str) -> Tag | None:
        return find_tag(tags, key, self.mode)

    def channel(self, ident: int) -> Channel:
        found = self.catalog.channel(ident)
        if found is None:
            raise InvalidData(f"no channel {ident}")
        return found

    def table(self, name: str, **options: Any) -> DataFrame:
        """blocks, index, tests, channels, dims, tags or decoders."""
        return datasource.read(self.spark, self.path, table=name, mode=self.mode, **options)

    def read(self, channel: int, transforms: bool = True, scan_limit: int | None = None, **options: Any) -> DataFrame:
        """A channel's rows: block, scan, dim0, dim1 and so on."""
        rows = datasource.read(self.spark, self.path, channel=channel, mode=self.mode, **options)
        if transforms:
            rows = self.transform(channel, rows)
        return _rows.limit_scans(rows, scan_limit) if scan_limit is not None else rows

    def transform(self, channel: int, rows: DataFrame) -> DataFrame:
        """A channel's transforms on rows read without."""
        found = _rows.channel_transforms(self.channel(channel))
        others = {x.index_channel: self.read(x.index_channel) for x in found.values() if x.kind == "index" and x.index_channel is not None and x.index_channel != channel}
        return _rows.transformed(rows, found, others)

    def decode(self, channel: int, blocks: DataFrame) -> DataFrame:
        """A channel's rows out of a table of blocks (group, block, payload), wherever it is from."""
        group, program, columns = self.catalog.binding(self.channel(channel))
        return decode_blocks(blocks.where(blocks["group"] == group), program, columns)

    def lower_bound(self, channel: int, dim: int, x: float) -> tuple[int, int] | None:
        """(block, scan) of the first row at or above x; the dimension must not fall. About log2 of the blocks are read, here and now."""
        return self._bound(channel, dim, x, False)

    def upper_bound(self, channel: int, dim: int, x: float) -> tuple[int, int] | None:
        """(block, scan) of the last row at or below x; the dimension must not fall. About log2 of the blocks are read, here and now."""
        return self._bound(channel, dim, x, True)

    def _bound(self, channel: int, dim: int, x: float, upper: bool) -> tuple[int, int] | None:
        c = self.channel(channel)
        at = [d for d in c.dims if d.index == dim]
        t = at[0].transform if at else None
        if t is not None and (t.kind == "index" or t.kind == "linear" and t.scale <= 0):  # needs another channel, or falls
            found = (_rows.upper_bound if upper else _rows.lower_bound)(self.read(channel), f"dim{dim}", x).first()
            return tuple(found) if found else None
        with Recording(self.path, mode=self.mode) as recording:
            return recording.bound(recording.catalog.channel(channel), dim, x, upper, t.of if t is not None else float)

    def histogram(self, channel: int) -> _histogram.Histogram:
        return _histogram.histogram(self.read(channel))

    def crush(self, channel: int, ideal: int) -> DataFrame:
        return _crush.crush(self.read(channel), ideal)

    def export(self, channel: int, path: str, digits: int = 15) -> None:
        """A channel as text, a line a row, in order: numbers with so many digits, binary as hexadecimal, tabs between."""
        rows = self.read(channel)
        cells = [(c, t == "binary") for c, t in rows.dtypes if c.startswith("dim")]
        rows.repartitionByRange("block").sortWithinPartitions("block", "scan").select(_text.exported(cells, digits).alias("value")).write.text(path)

    def dump(self, most_rows: int = 20) -> str:
        """A listing for people: tests, channels, tags and the first rows."""
        lines = [f"file {self.path}"]
        shown = lambda t: f"{t.key} = {t.value if len(t.value) <= 50 else f'<{len(t.value)} characters>'}"
        lines += [f"  tag {shown(t)}" for t in self.tags()]
        for test in self.tests():
            lines.append(f"test {test.id} {test.name}".rstrip())
            lines += [f"  tag {shown(t)}" for t in test.tags]
            for c in test.channels:
                lines.append(f"  channel {c.id} {c.name}, group {c.group}, {len(c.dims)} dimensions")
                lines += [f"    tag {shown(t)}" for t in c.tags]
                try:
                    self.catalog.binding(c)
                except InvalidData as e:
                    lines.append(f"    {e}")
                    continue
                for r in self.read(c.id).orderBy("block", "scan").limit(most_rows).collect():
                    cells = [x[:16].hex(" ") + (" ..." if len(x) > 16 else "") if isinstance(x, bytes | bytearray) else repr(x) for x in tuple(r)[2:]]
                    lines.append(f"    scan[{r.block}, {r.scan}]: " + "; ".join(f"v[{i}] = {x}" for i, x in enumerate(cells)))
        return "\n".join(lines)


def open_file(spark: SparkSession, path: str, mode: str = "reference") -> File:
    return File(spark, path, mode)


def sift(path: str, out: str, channels: list[tuple[int, int, int | None]]) -> int:
    """A new file with (channel, first block, end block or None) of another; returns its size."""
    return _sift.sift_file(path, out, channels)


def recover(path: str, mod: int = 0, accept_zero: bool = False) -> _recover.Recovered:
    """What can be saved of a damaged file."""
    with open(path, "rb") as f:
        return _recover.recover(f.read(), mod, accept_zero)
