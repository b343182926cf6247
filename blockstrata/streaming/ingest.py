"""Recordings as they come: chunks of bytes to blocks, counts by group, ends of groups, changing metadata.

A stream of chunks (source, seq, data) is turned into blocks with state: what is left of the
last chunk waits for the next, so chunks may be cut anywhere. Chunks of one source must come
in the order of seq within a batch and from batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockstrata.sources.catalog import Catalog, Definitions
from blockstrata.sources.datasource import register
from blockstrata.sources.framing import XML_GROUP, StreamParser

BLOCKS = "source string, offset long, group long, payload binary, crc_ok boolean"


def blocks_of(chunks: DataFrame, legacy: bool = False) -> DataFrame:
    """Blocks out of streamed chunks (source, seq, data); keyed by source, so sources run side by side."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parser = StreamParser(legacy)
        if state.exists:
            parser.held, parser.base = state.get
            parser.held = bytes(parser.held)
        rows = []
        for data in pd.concat(list(parts)).sort_values("seq")["data"]:
            rows += [(key[0], b.offset, b.group, b.payload, b.crc_ok) for b in parser.feed(bytes(data))]
        state.update((parser.held, parser.base))
        yield pd.DataFrame(rows, columns=["source", "offset", "group", "payload", "crc_ok"])

    return chunks.groupBy("source").applyInPandasWithState(run, BLOCKS, "held binary, base long", "append", GroupStateTimeout.NoTimeout)


def parse_chunks(chunks: DataFrame, legacy: bool = False) -> DataFrame:
    """The same for a table of all chunks at once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parser, rows = StreamParser(legacy), []
        for source, data in group.sort_values("seq")[["source", "data"]].itertuples(index=False):
            rows += [(source, b.offset, b.group, b.payload, b.crc_ok) for b in parser.feed(bytes(data))]
        return pd.DataFrame(rows, columns=["source", "offset", "group", "payload", "crc_ok"])

    return chunks.groupBy("source").applyInPandas(run, BLOCKS)


def group_counts(blocks: DataFrame) -> DataFrame:
    """Running blocks, bytes and end of each source's groups: an empty block ends a group."""
    size = F.octet_length("payload")
    return blocks.groupBy("source", "group").agg(F.count("*").alias("blocks"), F.sum(size).alias("bytes"), F.max((size == 0).cast("int")).cast("boolean").alias("closed"))


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a folder's recordings as they grow."""
    register(spark)
    return spark.readStream.format("recording").option("path", path).load()


class Follower:
    """For ``foreachBatch``: keeps the catalog up with the XML that comes, and hands it on with each batch's blocks.

    Metadata are kilobytes, so they are collected; data blocks stay where they are.
    """

    def __init__(self, then: Callable[[DataFrame, Catalog, int], Any], mode: str = "reference") -> None:
        self.definitions, self.then, self.mode = Definitions(), then, mode

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            for row in batch.where(F.col("group") == XML_GROUP).orderBy("offset").select("payload").collect():
                self.definitions.feed(bytes(row.payload).decode("utf-8", "replace"))
            self.then(batch, Catalog(self.definitions, self.mode), epoch)
        finally:
            batch.unpersist()
