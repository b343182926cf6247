"""Operators on a channel's rows: projection, transforms, position, limits, bounds, comparison.

Rows have ``block`` and ``scan``, which together are their order, and dimensions dim0, dim1
and so on. Everything is a projection, a filter or one aggregation, and no row order is relied
on after a shuffle. Filters on rows work behind the decoder; to read fewer blocks or dimensions, say so
to the data source (``from_block``, ``to_block``, ``dims``) or filter the blocks before they are decoded (``reaching``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockstrata.errors import FileSeekError, InvalidData
from blockstrata.sources.catalog import Channel, Transform

ORDER = ("block", "scan")
#: Tables of at most this many entries are constants in the plan; larger ones are joined.
MOST_INLINE = 4096


def dims_of(rows: DataFrame) -> list[str]:
    return sorted((c for c in rows.columns if c.startswith("dim") and c[3:].isdigit()), key=lambda c: int(c[3:]))


def _numeric(rows: DataFrame, dim: str) -> str:
    if dim not in rows.columns:
        raise InvalidData(f"no {dim}")
    if isinstance(rows.schema[dim].dataType, T.BinaryType):
        raise InvalidData(f"{dim} is binary")
    return dim


# ---- projection ----


def combine(rows: DataFrame, mapping: Sequence[int | None], prefix: str = "v") -> DataFrame:
    """dim i is column ``mapping[i]``; none or one that is not there gives null. A column may be used twice."""
    found = [c for c in rows.columns if not (c.startswith(prefix) and c[len(prefix) :].isdigit())]
    dims = [F.col(f"{prefix}{v}") if v is not None and f"{prefix}{v}" in rows.columns else F.lit(None).cast("double") for v in mapping]
    return rows.select(*found, *(d.alias(f"dim{i}") for i, d in enumerate(dims)))


# ---- transforms ----


def linear(x: Column, scale: float, offset: float) -> Column:
    """x * scale + offset, in this order, so that results are equal to the last bit."""
    return x * F.lit(float(scale)) + F.lit(float(offset))


def lookup(x: Column, table: Sequence[float]) -> Column:
    """table[x] for whole x in range, counted from 0 and below 0 as 0; else x."""
    index = F.when(F.isnan(x) | (x < 0), 0).when(x < len(table), F.floor(x)).otherwise(len(table)).cast("int")
    return F.coalesce(F.get(F.array(*(F.lit(float(t)) for t in table)), index), x) if len(table) else x


def lookup_table(rows: DataFrame, dim: str, table: DataFrame) -> DataFrame:
    """The same by a join, for tables (idx long, value double) too large for a constant; Spark broadcasts a side that proves small."""
    index = F.when(F.isnan(dim) | (F.col(dim) < 0), 0).otherwise(F.floor(dim)).cast("long")
    joined = rows.withColumn("_idx", index).join(table.select(F.col("idx").alias("_idx"), F.col("value").alias("_value")), "_idx", "left")
    return joined.withColumn(dim, F.coalesce("_value", dim)).drop("_idx", "_value")


def transformed(rows: DataFrame, transforms: dict[int, Transform], others: dict[int, DataFrame] | None = None) -> DataFrame:
    """Rows with each dimension's transform applied; binary dimensions and kind ``none`` stay. Applied to raw rows later it gives what reading with transforms gives.

    ``others`` has, for transforms of kind index, the rows of the channels that they look in, by channel id.
    """
    for index, x in transforms.items():
        dim = f"dim{index}"
        if dim not in rows.columns or isinstance(rows.schema[dim].dataType, T.BinaryType):
            continue
        if x.kind == "linear":
            rows = rows.withColumn(dim, linear(F.col(dim), x.scale, x.offset))
        elif x.kind == "map" and len(x.table) <= MOST_INLINE:
            rows = rows.withColumn(dim, lookup(F.col(dim), x.table))
        elif x.kind == "map":
            table = rows.sparkSession.createDataFrame([(i, float(t)) for i, t in enumerate(x.table)], "idx long, value double")
            rows = lookup_table(rows, dim, table)
        elif x.kind == "index" and others and x.index_channel in others:
            other = others[x.index_channel]
            table = ordinal(other).select(F.col("row").alias("idx"), F.col(f"dim{x.index_dim}").alias("value"))
            rows = lookup_table(rows, dim, table)
    return rows


def channel_transforms(channel: Channel) -> dict[int, Transform]:
    return {i: d.transform for i, d in enumerate(channel.dims) if d.transform.kind != "none"}


def if_nonzero(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which an expression is not 0."""
    return rows.where(condition != 0)


# ---- position ----


def seek(rows: DataFrame, block: int) -> DataFrame:
    """Rows from a block on."""
    return rows.where(F.col("block") >= block)


def num_blocks(rows: DataFrame) -> int:
    last = rows.agg(F.max("block")).first()[0]
    return 0 if last is None else last + 1


def position(tell: int, size: int, to: int | None = None, by: int | None = None) -> int:
    """Where a seek to or by some blocks ends; beyond either end is an error."""
    target = to if to is not None else tell + (by or 0)
    if not 0 <= target <= size:
        raise FileSeekError(f"{target} is not in 0 to {size}")
    return target


#: Blocks whose counts one task adds up; one row for so many goes on.
_STRETCH = 1 << 14


def block_counts(rows: DataFrame) -> DataFrame:
    """(block, n): rows of each block."""
    return rows.groupBy("block").agg(F.count("*").alias("n"))


def block_starts(counts: DataFrame) -> DataFrame:
    """(block, before): how many rows come before each block, by sums of stretches of blocks and sums inside them."""
    stretch = F.floor(F.col("block") / _STRETCH)
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = counts.groupBy(stretch.alias("stretch")).agg(F.sum("n").alias("n")).select("stretch", before(Window.orderBy("stretch")).alias("first"))
    inside = counts.select("block", stretch.alias("stretch"), before(Window.partitionBy(stretch).orderBy("block")).alias("inside"))
    return inside.join(long, "stretch").select("block", (F.col("first") + F.col("inside")).alias("before"))


def ordinal(rows: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Rows with ``row``, their number from 0. Blocks are counted, not rows sorted; ``counts`` (block, n) spares the counting."""
    starts = block_starts(block_counts(rows) if counts is None else counts).withColumnRenamed("before", "_before")
    inside = Window.partitionBy("block").orderBy("scan")
    return rows.join(starts, "block").withColumn("row", F.col("_before") + F.row_number().over(inside) - 1).drop("_before")


def limit_scans(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of every block."""
    return rows.where(F.col("scan") < most)


def limit_total(rows: DataFrame, most: int) -> DataFrame:
    """The first rows of all."""
    return rows.orderBy(*ORDER).limit(most)


def trim(rows: DataFrame, start: int, size: int) -> DataFrame:
    """Rows start to start + size of each block, numbered from 0; ``scan_offset`` says where they began."""
    kept = rows.where((F.col("scan") >= start) & (F.col("scan") < start + size))
    return kept.withColumn("scan", F.col("scan") - start).withColumn("scan_offset", F.lit(start).cast("long"))


# ---- bounds ----


def lower_bound(rows: DataFrame, dim: str, x: float) -> DataFrame:
    """(block, scan) of the first row at or above x, none if there is none; the dimension must not fall."""
    at = F.min(F.struct("block", "scan"))
    return rows.where(F.col(_numeric(rows, dim)) >= x).agg(at.alias("at")).where("at IS NOT NULL").select("at.block", "at.scan")


def upper_bound(rows: DataFrame, dim: str, x: float) -> DataFrame:
    """(block, scan) of the last row at or below x, none if there is none."""
    at = F.max(F.struct("block", "scan"))
    return rows.where(F.col(_numeric(rows, dim)) <= x).agg(at.alias("at")).where("at IS NOT NULL").select("at.block", "at.scan")


def zones(rows: DataFrame, dim: str) -> DataFrame:
    """Least and greatest value of each block, by which a range read can leave blocks out."""
    return rows.groupBy("block").agg(F.min(dim).alias("low"), F.max(dim).alias("high"), F.count("*").alias("rows"))


def reaching(blocks: DataFrame, zone: DataFrame, low: float, high: float) -> DataFrame:
    """Blocks that reach into a range, by what is stored or known of each (block, low, high), before any is decoded."""
    return blocks.join(zone.where((F.col("high") >= low) & (F.col("low") <= high)).select("block"), "block", "left_semi")


def between(rows: DataFrame, dim: str, low: float, high: float, zone: DataFrame | None = None) -> DataFrame:
    """Rows in a range; with zones, only of blocks that reach into it."""
    if zone is not None:
        rows = rows.join(zone.where((F.col("high") >= low) & (F.col("low") <= high)).select("block"), "block", "left_semi")
    return rows.where(F.col(_numeric(rows, dim)).between(low, high))


# ---- cells and comparison ----


def cell(rows: DataFrame, dim: str, block: int, scan: int) -> object:
    """One value, or None where there is none."""
    if dim not in rows.columns:
        return None
    found = rows.where((F.col("block") == block) & (F.col("scan") == scan)).select(dim).first()
    return found[0] if found else None


def value_range(rows: DataFrame, dim: str, block: int, start: int, count: int, binary: bool = False) -> list:
    """Up to ``count`` values of a block from a row on; fewer at its end, none beyond."""
    if dim not in rows.columns or isinstance(rows.schema[dim].dataType, T.BinaryType) != binary:
        raise InvalidData(f"{dim} has no such values")
    part = rows.where((F.col("block") == block) & (F.col("scan") >= start) & (F.col("scan") < start + count))
    return [r[0] for r in part.orderBy("scan").select(dim).collect()]


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other has not, repeated rows counted; none for equal tables. NaN differs from NaN."""
    if a.dtypes != b.dtypes:
        raise InvalidData("shapes or types differ")
    one, two = a.withColumn("side", F.lit("left")), b.withColumn("side", F.lit("right"))
    both = one.unionByName(two).groupBy(*a.columns).agg(F.sum(F.when(F.col("side") == "left", 1).otherwise(-1)).alias("surplus"))
    nan = [F.coalesce(F.isnan(c), F.lit(False)) for c, t in a.dtypes if t in ("double", "float")]
    odd = nan[0] if nan else F.lit(False)
    for n in nan[1:]:
        odd = odd | n
    return both.where((F.col("surplus") != 0) | odd)


def equal(a: DataFrame, b: DataFrame) -> bool:
    return a.dtypes == b.dtypes and differences(a, b).isEmpty()
