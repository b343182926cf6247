"""Groups of blocks: totals, sizes of what will be written and tables of metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.sources.framing import OVERHEAD
from blockstrata.sources.writer import FLUSH, INDEX_ENTRY


def group_totals(blocks: DataFrame) -> DataFrame:
    """blocks and payload bytes of each group, and whether an empty block has closed it."""
    size = F.col("payload_size") if "payload_size" in blocks.columns else F.octet_length("payload")
    return blocks.groupBy("group").agg(F.count("*").alias("blocks"), F.sum(size).cast("long").alias("bytes"), F.max((size == 0).cast("int")).cast("boolean").alias("closed"))


def highest_group(blocks: DataFrame) -> int:
    return blocks.agg(F.max("group")).first()[0] or 0


def written_size(blocks: DataFrame, index: bool = True) -> DataFrame:
    """One row: blocks, payload bytes, and the bytes of a file that holds them, with index blocks if asked for."""
    size = F.octet_length("payload") if "payload" in blocks.columns else F.col("payload_size")
    per_block = FLUSH // INDEX_ENTRY + 1
    n, payload = F.count("*"), F.coalesce(F.sum(size), F.lit(0))
    total = payload + n * OVERHEAD
    if index:
        total = total + n * INDEX_ENTRY + F.ceil(n / per_block) * OVERHEAD
    return blocks.agg(n.alias("blocks"), payload.cast("long").alias("payload_bytes"), total.cast("long").alias("file_bytes"))


def group_scan(blocks: DataFrame, group: int, start: int = 0) -> DataFrame:
    """A group's payloads in order, from a block on."""
    return blocks.where((F.col("group") == group) & (F.col("block") >= start)).orderBy("block").select("block", "payload")


def tag_values(tags: DataFrame, blocks: DataFrame) -> DataFrame:
    """Tags with ``value_bin``, for those kept in a group the group's payloads end to end."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "payload"))), lambda x: F.hex(x["payload"])), "")
    values = blocks.groupBy(F.col("group").alias("group_id")).agg(F.unhex(joined).alias("value_bin"))
    return tags.join(values, "group_id", "left")


def channels_with_tests(channels: DataFrame, tests: DataFrame) -> DataFrame:
    """Each channel with its test's name."""
    keys = ["file", "test_id"] if "file" in channels.columns and "file" in tests.columns else ["test_id"]
    return channels.join(tests.withColumnRenamed("name", "test_name"), keys)


def first_tags(tags: DataFrame, mode: str = "reference") -> DataFrame:
    """One tag for each owner and key: the first, or in ``spec`` mode the last."""
    pick = F.min_by if mode == "reference" else F.max_by
    owner = [c for c in ("file", "owner_kind", "owner_id", "dim_index") if c in tags.columns]
    return tags.groupBy(*owner, "key").agg(pick("value", "ord").alias("value"))
