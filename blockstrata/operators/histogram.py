"""Histograms out of channels: one value, then a lower and an upper bound for each axis.

Bins of an axis are its distinct bounds in order; a later row of the same bin replaces an
earlier one. A histogram here is its filled bins and its axes; the dense cube is made on
demand, row-major with the last axis fastest.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockstrata.errors import InvalidData
from blockstrata.operators.rows import dims_of


@dataclass
class Histogram:
    """``axes``: axis, bin, lower, upper. ``bins``: i0, i1 and so on, flat, value; one row a filled bin."""

    axes: DataFrame
    bins: DataFrame
    sizes: list[int]

    def total(self) -> int:
        return reduce(lambda a, b: a * b, self.sizes, 1)

    def flat(self, indices: list[Column]) -> Column:
        return reduce(lambda a, x: a * F.lit(x[1]) + x[0], zip(indices, self.sizes, strict=True), F.lit(0).cast("long"))

    def unflat(self, flat: int) -> list[int]:
        out = []
        for size in reversed(self.sizes):
            flat, i = divmod(flat, size)
            out.append(i)
        return out[::-1]

    def dense(self) -> DataFrame:
        """Every bin, 0 where nothing was counted: flat, i0, i1 and so on, value."""
        spark = self.bins.sparkSession
        rows = spark.range(self.total()).withColumnRenamed("id", "flat")
        step = 1
        for axis in range(len(self.sizes) - 1, -1, -1):
            rows = rows.withColumn(f"i{axis}", (F.floor(F.col("flat") / step) % self.sizes[axis]).cast("long"))
            step *= self.sizes[axis]
        joined = rows.join(self.bins.select("flat", "value"), "flat", "left")
        return joined.select("flat", *(f"i{a}" for a in range(len(self.sizes))), F.coalesce("value", F.lit(0.0)).alias("value"))

    def nonzero(self) -> DataFrame:
        """Bins that are not 0, by flat index."""
        return self.bins.where("value <> 0").orderBy("flat")

    def value(self, *indices: int) -> float:
        """One bin's value; 0 beyond the axes and where nothing was counted."""
        if len(indices) != len(self.sizes) or any(not 0 <= i < n for i, n in zip(indices, self.sizes, strict=True)):
            return 0.0
        found = self.bins.where(reduce(lambda a, b: a & b, (F.col(f"i{k}") == i for k, i in enumerate(indices)))).select("value").first()
        return found[0] if found else 0.0

    def next_nonzero(self, start: int = 0) -> tuple[int, float] | None:
        """(flat index, value) of the first bin from ``start`` on that is not 0."""
        found = self.bins.where((F.col("value") != 0) & (F.col("flat") >= start)).agg(F.min(F.struct("flat", "value")).alias("x")).first().x
        return tuple(found) if found else None

    def with_bin(self, value: float, *indices: int) -> Histogram:
        """With one bin set; indices beyond the axes change nothing."""
        if len(indices) != len(self.sizes) or any(not 0 <= i < n for i, n in zip(indices, self.sizes, strict=True)):
            return self
        flat = reduce(lambda a, x: a * x[1] + x[0], zip(indices, self.sizes, strict=True), 0)
        row = self.bins.sparkSession.range(1).select(*(F.lit(i).cast("long").alias(f"i{k}") for k, i in enumerate(indices)), F.lit(flat).cast("long").alias("flat"), F.lit(float(value)).alias("value"))
        return Histogram(self.axes, self.bins.where(F.col("flat") != flat).unionByName(row), self.sizes)

    def with_bin_at(self, value: float, *bounds: tuple[float, float]) -> Histogram:
        """With the bin of exactly these bounds set."""
        indices = [self.find(a, *pair) for a, pair in enumerate(bounds)]
        if len(indices) != len(self.sizes) or None in indices:
            raise InvalidData(f"no bin {bounds}")
        return self.with_bin(value, *indices)

    def bounds(self, axis: int) -> DataFrame:
        return self.axes.where(F.col("axis") == axis).select("bin", "lower", "upper").orderBy("bin")

    def find(self, axis: int, lower: float, upper: float) -> int | None:
        """The bin with exactly these bounds."""
        found = self.axes.where((F.col("axis") == axis) & (F.col("lower") == lower) & (F.col("upper") == upper)).select("bin").first()
        return found[0] if found else None


def histogram(rows: DataFrame) -> Histogram:
    """From rows with dim0 the value and dims 1 and 2, 3 and 4 and so on the bounds; block and scan say what came later."""
    dims = dims_of(rows)
    if len(dims) < 3 or len(dims) % 2 == 0:
        raise InvalidData("a histogram has a value and two bounds for each axis")
    count = (len(dims) - 1) // 2
    sides = [(F.col(f"dim{2 * a + 1}"), F.col(f"dim{2 * a + 2}")) for a in range(count)]
    # one pass finds the distinct bounds of all axes
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), lo.cast("double").alias("lower"), hi.cast("double").alias("upper")) for a, (lo, hi) in enumerate(sides)))).alias("x")).select("x.*").distinct()
    axes = each.withColumn("bin", (F.dense_rank().over(Window.partitionBy("axis").orderBy("lower", "upper")) - 1).cast("long"))
    found = dict(axes.groupBy("axis").agg(F.count("*")).collect())
    sizes = [found.get(a, 0) for a in range(count)]
    last = F.max_by(F.col("dim0"), F.struct("block", "scan")).alias("value")
    cells = rows.groupBy(*(c.cast("double").alias(f"{side}{a}") for a, pair in enumerate(sides) for side, c in zip(("lower", "upper"), pair, strict=True))).agg(last)
    for a in range(count):
        axis = axes.where(F.col("axis") == a).select(F.col("bin").alias(f"i{a}"), F.col("lower").alias(f"l{a}"), F.col("upper").alias(f"u{a}"))
        cells = cells.join(axis, F.col(f"lower{a}").eqNullSafe(F.col(f"l{a}")) & F.col(f"upper{a}").eqNullSafe(F.col(f"u{a}")))
    out = Histogram(axes, cells, sizes)
    out.bins = cells.select(*(f"i{a}" for a in range(count)), out.flat([F.col(f"i{a}") for a in range(count)]).alias("flat"), F.col("value").cast("double").alias("value"))
    return out
