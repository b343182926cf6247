"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockstrata.llm._base import Staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_steps: int = 60) -> Staged:
    """(u, v): v is the smallest node that u reaches, for each u that is not the smallest of its component.

    ``edges`` (u, v) are longs; those with a null and loops are left out, direction and repeats do not matter, no
    edges give no rows. A node's neighbours are reduced to their minimum by partial aggregation; the join that brings
    it back reads a hub's edges (16 bytes each, never expanded) in one task.
    """
    now = Staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_steps):
        new = Staged(_small_star(_large_star(now.read())), "stars")
        now.drop()
        now, (seen, mark) = new, (mark, _mark(new))
        if seen == mark:
            return now
    raise RuntimeError("components did not settle")


def _mark(edges: Staged) -> tuple[int, int, int]:
    """Count and order-free sums of hashes: equal only for equal tables, but for chance."""
    big = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(20,0)"))
    got = edges.read().agg(F.count("*"), big(1), big(2)).first()
    return got[0], int(got[1] or 0), int(got[2] or 0)
