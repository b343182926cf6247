"""Best-fit packing into sequences of several permitted lengths.

Pieces are taken longest first. Each goes to the open bin that it leaves fullest; where
none has room, a bin is opened at the permitted length of least expected cost for each
token held, given what is still to be placed and would fit beside it. At the end each bin
shrinks to the smallest permitted length that holds its contents, so the lengths are
chosen jointly, by what came together.

Texts longer than the largest length are cut into pieces of that length and a rest;
nothing is dropped. Pieces are dealt evenly to tasks of bounded size and packed there.

Defined results: a null or negative length counts as 0 and its document takes no room but
has a place; an empty table gives an empty result; repeated rows are packed each; columns
named like an output column are replaced, all others pass whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blockstrata.llm._base import clashing, private, spread, tidied, with_text
from blockstrata.llm.token_files import ChunkEncoder

LENGTHS = (1024, 2048, 4096, 8192)
#: What a sequence costs beside its length, in tokens.
OVERHEAD = 64
#: Pieces that one task packs, about.
AT_MOST, AT_LEAST = 50_000, 2_000


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, int]]:
    """(bin, offset) of each size; sizes must come longest first and fit the largest length."""
    lengths, out = sorted(lengths), []
    up = np.asarray(sizes[::-1], np.int64)  # shortest first
    total = np.concatenate([[0], np.cumsum(up)])
    open_bins: dict[int, list[int]] = {}  # by room left
    mask, used = 0, []
    for i, size in enumerate(sizes):
        found = mask >> size
        if found:
            room = size + (found & -found).bit_length() - 1
            stack = open_bins[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            rest, best, room = len(sizes) - 1 - i, None, 0
            for length in lengths:
                if length >= size:
                    fits = min(rest, int(np.searchsorted(up, length - size, side="right")))
                    cost = (length + overhead) / max(1, size + min(length - size, int(total[fits])))
                    if best is None or cost < best:
                        best, room = cost, length
            b = len(used)
            used.append(0)
        out.append((b, used[b]))
        used[b] += size
        room -= size
        open_bins.setdefault(room, []).append(b)
        mask |= 1 << room
    return out


def pack_sequences(df: DataFrame, size: str, lengths: Sequence[int] = LENGTHS, overhead: int = OVERHEAD) -> DataFrame:
    """A row for each piece of each row of ``df``: its columns, piece, start, n_tokens, bin, offset (in the bin), length (the bin's), used."""
    names = ("piece", "start", "n_tokens", "bin", "offset", "length", "used")
    most = max(lengths)
    whole = F.greatest(F.coalesce(F.col(size), F.lit(0)).cast("long"), F.lit(0))
    (total,) = private(df, "whole")
    rows = clashing(df.withColumn(total, whole), *names)
    own = [c for c in rows.columns if c != total]
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col(total) / most) - 1, F.lit(0)).cast("int"))))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * most).withColumn("n_tokens", F.least(F.col(total) - F.col("start"), F.lit(most)).cast("long")).drop(total)
    n = rows.agg(F.sum(F.greatest(F.ceil(F.col(total) / most), F.lit(1)))).first()[0] or 0
    tasks = max(1, -(-n // AT_MOST), min(spread(df.sparkSession), -(-n // AT_LEAST)))
    schema = T.StructType([*pieces.schema, T.StructField("bin", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("used", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        part = pa.Table.from_batches(held).combine_chunks()
        keys = [(c, "ascending") for c in ("doc_id", "piece") if c in part.column_names]
        part = part.sort_by([("n_tokens", "descending"), *keys])
        got = np.array(pack(part["n_tokens"].to_pylist(), lengths, overhead), np.int64)
        sizes = part["n_tokens"].to_numpy()
        used = np.bincount(got[:, 0], sizes).astype(np.int64)
        permitted = np.array(sorted(lengths))
        final = permitted[np.searchsorted(permitted, used)]
        base = TaskContext.get().partitionId() << 40
        for name, values in (("bin", got[:, 0] + base), ("offset", got[:, 1]), ("length", final[got[:, 0]]), ("used", used[got[:, 0]])):
            part = part.append_column(name, pa.array(values))
        yield from part.combine_chunks().to_batches()

    return pieces.select(*own, "piece", "start", "n_tokens").repartition(tasks).mapInArrow(tidied(run, keep_tables=True), schema)


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", keep: Sequence[str] = ("doc_id",), end: int = 1, table: int = 1_500_000, at_once: int = 2 << 20, keep_table: bool = True) -> DataFrame:
    """``keep`` of ``docs`` and ``n_ids``: the tokenizer's ids of the whole text and ``end`` more; ``table`` chunks are remembered, from task to task or not, ``at_once`` bytes worked on."""
    kept = clashing(docs.select(*keep), "n_ids")
    own = kept.columns
    rows, place = with_text(docs, own, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder.of(tokenizer, table)
        for batch in batches:
            for a, e, _, at in encoder.chunks(batch.column(place), at_once):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, e - a) for i in range(len(own))), pa.array(np.diff(at) + end)], [*own, "n_ids"])

    return rows.mapInArrow(tidied(run, keep_table), T.StructType([*kept.schema, T.StructField("n_ids", T.LongType())]))
