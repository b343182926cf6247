import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from blockstrata.llm import queries, sharding


def _check(rows, n, tolerance):
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert set(sizes) <= set(range(n))
    fair = sum(sizes.values()) / n
    assert max(sizes.values()) <= fair * (1 + tolerance) + max(r.size for r in rows)


def test_even_bytes_with_a_hot_text(spark, as_dir):
    hot = "same text " * 20
    rows = [(i, hot if i % 3 == 0 else f"text {i} " * (1 + i % 40)) for i in range(6000)]
    out = queries.op1_sharding(spark, as_dir(documents=spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(out) == 6000
    _check(out, 8, 0.04)
    by_text = defaultdict(set)
    for r in out:
        text = rows[r.doc_id][1]
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes", None)
        by_text[r.text_crc32].add(r.shard)
    assert sum(len(v) > 1 for v in by_text.values()) == 1  # only the hot group is cut


def test_odd_and_empty(spark, odd, none, as_dir):
    out = queries.op1_sharding(spark, as_dir(documents=odd)).collect()
    assert len(out) == 18
    _check(out, 8, 0.04)
    assert queries.op1_sharding(spark, as_dir(documents=none)).collect() == []
    kept = sharding.shard(odd.withColumn("h", F.xxhash64("text")).withColumn("n", F.lit(None).cast("long")), "h", "doc_id", "n", shards=3)
    assert "Slot" not in kept.columns and sorted(r.slot for r in kept.where("shard = 0").collect())[0] == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h"), F.lit(3).alias("n"))
    sharding.write_shards(sharding.shard(df, "h", "doc_id", "n", shards=4), str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 500 and {r[0] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_own_names_may_clash_and_ranges_follow_the_size(spark):
    df = spark.range(400).select(F.col("id").alias("_id"), F.xxhash64("id").alias("_key"), F.lit(5).alias("_size"), F.lit("r").alias("_range"), F.lit(1).alias("key"), F.lit(2).alias("id"))
    for limit in (1 << 28, 4):
        rows = sharding.shard(df, "_key", "_id", "_size", shards=3, pieces=2, range_bytes=limit).collect()
        assert sorted(r._id for r in rows) == list(range(400)) and {(r._size, r._range, r.key, r.id) for r in rows} == {(5, "r", 1, 2)}
        assert all(sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows))) for k in range(3))
