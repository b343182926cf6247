"""Sharding by sampled splitters; DataFrame functions only.

A size-weighted sample of keys gives quantile boundaries, records fall into the
ranges between them, ranges that turn out overfull are sampled again and
subdivided, and whole ranges are dealt to shards by their exact sizes. Shards
therefore hold nearly the same number of bytes, equal keys stay in one shard
unless their group alone outweighs a range, and a hot group is cut by record id.

Defined results: a null size counts as 1, a null id sorts first, an empty table
gives an empty result, repeated rows each get their own slot. Columns of the
input named like an output column are replaced, all others pass whatever their names.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockstrata.llm._base import clashing, private

_LEAST = -(1 << 63)


class _Names(NamedTuple):
    """Names of the operator's own columns, which no column of the input has."""

    key: str
    id: str
    size: str
    range: str


def _draw(rows: DataFrame, names: _Names, total: int, wanted: int, seed: int) -> list[tuple[int, int, float]]:
    """Keys drawn with a chance in proportion to size, sure for the largest, each with the size that it stands for."""
    step = total / wanted
    chance = F.col(names.size) / F.lit(step)
    u = F.pmod(F.xxhash64(names.key, names.id, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    found = rows.where(u < chance).select(names.key, names.id, F.greatest(F.col(names.size).cast("double"), F.lit(step)).alias("w"))
    return sorted((r[0], r[1], r[2]) for r in found.collect())


def _quantiles(sample: list[tuple[int, int, float]], pieces: int, light: float) -> list[tuple[int, int]]:
    """Boundaries between ``pieces`` even parts of a sample; those inside a key of at most ``light`` move to its start."""
    total, weights = sum(x[2] for x in sample), {}
    for key, _, w in sample:
        weights[key] = weights.get(key, 0) + w
    out, done = set(), 0.0
    for key, ident, w in sample:
        if int(done * pieces / total) != int((done + w) * pieces / total):
            out.add((key, _LEAST if weights[key] <= light else ident))
        done += w
    return sorted(out)


def _range_of(names: _Names, splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below a record's (key, id): a two-level search of constant arrays."""
    if not splitters:
        return F.lit(0)
    width = max(1, int(len(splitters) ** 0.5))
    at = F.struct(F.col(names.key).alias("k"), F.col(names.id).alias("i"))
    as_array = lambda items: F.from_json(F.lit(json.dumps([{"k": k, "i": i} for k, i in items])), "array<struct<k: bigint, i: bigint>>")
    coarse = F.size(F.filter(as_array(splitters[width - 1 :: width]), lambda s: s <= at))
    fine = F.filter(F.slice(as_array(splitters), coarse * width + 1, width), lambda s: s <= at)
    return coarse * width + F.size(fine)


def shard(df: DataFrame, key: str, ident: str, size: str, shards: int = 8, pieces: int = 64, range_bytes: int = 256 << 20, draws: int = 24, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    ``key`` is a long by which equal records are kept together (a hash of the text, say),
    ``ident`` a long that subdivides hot keys. A shard has ``pieces`` ranges, and more where a
    range would exceed ``range_bytes`` in sizes, so a range bounds both the unevenness and what
    one task numbers. The driver sees the sample (``draws`` for each range) and one row a range.
    """
    rows = clashing(df, "shard", "slot")
    names = _Names(*private(rows, "key", "id", "size", "range"))
    rows = rows.withColumns({names.key: F.coalesce(df[key], F.lit(0)).cast("long"), names.id: F.coalesce(df[ident], F.lit(_LEAST)).cast("long"), names.size: F.coalesce(F.greatest(df[size], F.lit(1)), F.lit(1)).cast("long")})
    total = rows.agg(F.sum(names.size)).first()[0]
    if not total:
        return rows.drop(*names).withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    pieces = max(pieces, -(-total // (shards * range_bytes)))
    fair = total / (shards * pieces)
    splitters = _quantiles(_draw(rows, names, total, shards * pieces * draws, seed), shards * pieces, fair)
    for again in range(1, 5):
        placed = rows.withColumn(names.range, _range_of(names, splitters))
        sums = {r[0]: (r[1], r[2]) for r in placed.groupBy(names.range).agg(F.sum(names.size), F.count("*")).collect()}
        over = [k for k, (s, n) in sums.items() if s > 3 * fair and n > 1]
        if not over or again == 4:
            break
        heavy = sum(sums[k][0] for k in over)
        sample = _draw(placed.where(F.col(names.range).isin(over)), names, heavy, max(draws, int(draws * 2 * heavy / fair)), seed + again)
        finer = sorted({*splitters, *_quantiles(sample, max(2, int(2 * heavy / fair)), fair)}) if sample else splitters
        if finer == splitters:
            break
        splitters = finer
    # whole ranges go to the shard in which their middle lies; slots go on from range to range
    done, filled, home, first = 0, [0] * shards, [0] * (len(splitters) + 1), [0] * (len(splitters) + 1)
    for k in sorted(sums):
        s, n = sums[k]
        home[k] = min(shards - 1, int((done + s / 2) * shards / total))
        first[k], done = filled[home[k]], done + s
        filled[home[k]] += n
    of = lambda values: F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), F.col(names.range))
    order = Window.partitionBy(names.range).orderBy(names.key, names.id, names.size)
    return placed.withColumns({"shard": of(home).cast("int"), "slot": (of(first) + F.row_number().over(order) - 1).cast("long")}).drop(*names)


def write_shards(sharded: DataFrame, path: str, files: int = 4) -> None:
    """Each shard as a folder of Parquet files in slot order."""
    sharded.repartition(8 * files, "shard", F.pmod("slot", F.lit(files))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
