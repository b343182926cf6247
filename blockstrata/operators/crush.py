"""Min/max down-sampling of a channel to about as many points as a plot has.

With n rows and an ideal of k points the bucket is the smallest power of two p with
n < 2 * k * p; each bucket of p rows gives the least and greatest value of every dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockstrata.errors import InvalidData
from blockstrata.operators.rows import block_counts, dims_of, ordinal
from blockstrata.sources.shared import settled


def bucket_width(rows: int, ideal: int) -> int:
    if ideal < 1:
        raise ValueError("ideal must be at least 1")
    width = 1
    while rows >= 2 * ideal * width:
        width *= 2
    return width


def crush(rows: DataFrame, ideal: int, total: int | None = None, row: str | None = None) -> DataFrame:
    """bucket, then min and max of each dimension (out0, out1 for dim0 and so on), n. NaN counts only where a bucket has nothing else.

    ``row`` names a column that numbers the rows from 0 already; else they are numbered by block and scan,
    for which the rows of each block are counted once and the counts (a row a block) kept: two passes over the data in all.
    """
    dims = dims_of(rows)
    if any(isinstance(rows.schema[d].dataType, T.BinaryType) for d in dims):
        raise InvalidData("binary dimensions cannot be crushed")
    if row:
        numbered = rows
    else:
        counts = settled(block_counts(rows))
        numbered = ordinal(rows, counts)
        total = counts.agg(F.sum("n")).first()[0] or 0 if total is None else total
    width = bucket_width(rows.count() if total is None else total, ideal)
    plain = lambda d: F.when(~F.isnan(d), F.col(d))
    out = []
    for k, d in enumerate(dims):
        out += [F.coalesce(F.min(plain(d)), F.min(d)).alias(f"out{2 * k}"), F.coalesce(F.max(plain(d)), F.max(d)).alias(f"out{2 * k + 1}")]
    return numbered.groupBy(F.floor(F.col(row or "row") / width).alias("bucket")).agg(*out, F.count("*").alias("n"))
