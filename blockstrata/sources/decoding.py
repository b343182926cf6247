"""Payloads to rows: blocks in, decoded and projected columns out, in Arrow batches.

Programs with a numpy kernel decode a payload at once; others run row by row. Binary and
numeric columns are told apart by the program alone, so a NaN stays a number.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockstrata.plans.kernels import kernel
from blockstrata.plans.program import MAX_STEPS, Program


class Decoder:
    """A program ready to run on payloads."""

    def __init__(self, program: Program, vectorised: bool = True, steps: int = MAX_STEPS) -> None:
        self.program, self.steps = program, steps
        self.kernel = kernel(program) if vectorised else None

    def columns(self, payload: bytes) -> list[pa.Array]:
        """v0, v1 and so on as Arrow arrays."""
        if self.kernel is not None and (found := self.kernel.columns_of(payload)) is not None:
            return [pa.array(c) for c in found]
        rows = self.program.rows(payload, self.steps)
        return [pa.array([r[i] for r in rows], pa.binary() if raw else pa.float64()) for i, raw in enumerate(self.program.raw)]


def sample_schema(program: Program, columns: Sequence[int | None]) -> T.StructType:
    """block, scan, and a column for each dimension; without a column of the program it is null."""
    dims = [T.StructField(f"dim{i}", T.BinaryType() if v is not None and program.raw[v] else T.DoubleType()) for i, v in enumerate(columns)]
    return T.StructType([T.StructField("block", T.LongType()), T.StructField("scan", T.LongType()), *dims])


def decoded(decoder: Decoder, columns: Sequence[int | None], block: int, payload: bytes) -> pa.RecordBatch | None:
    """One payload's rows, projected: column i is the program's column ``columns[i]``, or null."""
    found = decoder.columns(payload)
    n = len(found[0]) if found else 0
    if not n:
        return None
    program = decoder.program
    dims = [found[v] if v is not None else pa.nulls(n, pa.float64()) for v in columns]
    names = ["block", "scan", *(f"dim{i}" for i in range(len(dims)))]
    types = [pa.binary() if v is not None and program.raw[v] else pa.float64() for v in columns]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n)), *(d.cast(t) for d, t in zip(dims, types, strict=True))], names)


def decode_blocks(blocks: DataFrame, program: Program, columns: Sequence[int | None] | None = None, keys: Sequence[str] = (), vectorised: bool = True, steps: int = MAX_STEPS) -> DataFrame:
    """Rows of ``blocks`` (block, payload, and ``keys`` to carry along): keys, block, scan, dim0, dim1 and so on. No shuffle."""
    columns = list(range(program.columns)) if columns is None else list(columns)
    plain = sample_schema(program, columns)
    carried = blocks.select(*keys).schema if keys else T.StructType([])
    schema = T.StructType([*carried, *plain])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(program, vectorised, steps)
        for batch in batches:
            ready, held = [], 0
            for i in range(batch.num_rows):
                payload = batch.column(len(keys) + 1)[i].as_py()
                rows = decoded(decoder, columns, batch.column(len(keys))[i].as_py(), payload) if payload else None
                if rows is not None:
                    same = [pa.repeat(batch.column(k)[i], rows.num_rows) for k in range(len(keys))]
                    ready.append(pa.RecordBatch.from_arrays([*same, *rows.columns], [*keys, *rows.schema.names]))
                    held += rows.num_rows
                if held > 100_000:
                    yield pa.concat_batches(ready)
                    ready, held = [], 0
            if ready:
                yield pa.concat_batches(ready)

    return blocks.select(*keys, F.col("block").cast("long"), "payload").mapInArrow(run, schema)


def frame(group: Column, payload: Column) -> Column:
    """A block's bytes, from its group and payload, as a column: framing needs no Python."""
    word = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    body = F.concat(word(F.octet_length(payload) + 20), word(group), F.unhex(F.lit("51EDA7A0")), payload)
    return F.concat(body, word(F.crc32(body)), word(F.octet_length(payload) + 20))


def unframe(data: Column) -> Column:
    """struct(size, group, payload, crc, ok) of a framed block; null where it is none."""
    number = lambda x: F.conv(F.hex(x), 16, 10).cast("long")
    at = lambda start, n: F.substring(data, start, n)
    size = F.octet_length(data)
    crc = number(F.substr(data, size - 7, F.lit(4)))
    body = F.substr(data, F.lit(1), size - 8)
    valid = (size >= 20) & (at(9, 4) == F.unhex(F.lit("51EDA7A0"))) & (number(at(1, 4)) == size) & (number(F.substr(data, size - 3, F.lit(4))) == size)
    return F.when(valid, F.struct(size.cast("long").alias("size"), number(at(5, 4)).alias("group"), F.substr(data, F.lit(13), size - 20).alias("payload"), crc.alias("crc"), ((crc == 0) | (crc == F.crc32(body))).alias("ok")))
