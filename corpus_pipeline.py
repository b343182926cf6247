"""Documents to packed training sequences, in five stages.

Quality rules and the site classifier reject documents, near duplicates leave one of each
group, passages that an earlier document has are cut out, and what stays is packed. Each
stage works on all that the one before kept; all but the last return the columns of
documents. Both classifiers are trained on the labelled rows of the original tables.

Defined results: an empty table passes through every stage as an empty one; other columns
than those of documents are left out; null lang or source is a site of its own; rows that
repeat a doc_id or have none are documents of their own to near-duplicate detection, and of
a group the one of the smallest doc_id stays (null is behind all others, of equal ids the
first by a hash of the row); a text of which passages are
cut loses the characters that the cut leaves incomplete, and n_chars follows; a document
of which nothing stays remains as an empty text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata.llm import exact_dedup, near_dup, packing, quality_rules, queries, site_quality
from blockstrata.llm._base import Staged, roots, small_transfers

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Working tables that results of the stages below still read.
_LEFT: list[Staged] = []


def _drop_left(spark: SparkSession, docs: DataFrame | None = None) -> None:
    """Drop what earlier stages of this session have left, but for what ``docs`` reads."""
    read = roots(docs) if docs is not None else set()
    for t in [t for t in _LEFT if t.spark.sparkContext is spark.sparkContext and not any(t.name in r for r in read)]:
        t.drop()
        _LEFT.remove(t)


def _begin(spark: SparkSession, docs: DataFrame) -> None:
    """What each stage does first: a stage's result is written before the next one runs, so what it was read from can go."""
    small_transfers(spark)
    _drop_left(spark, docs)


def keep_good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rules or the classifier reject go."""
    _begin(spark, docs)
    return quality_rules.judge(docs, queries.quality_model(spark, sf_dir), keep=list(COLUMNS)).where("kept").select(*COLUMNS)


def keep_good_sites(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose posterior, given their site, is against them go."""
    _begin(spark, docs)
    return site_quality.judge(docs, queries.quality_model(spark, sf_dir), keep=list(COLUMNS)).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates (five words, 0.8): of each group the row with the smallest doc_id stays."""
    _begin(spark, docs)
    count = docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids")).first()
    key = "doc_id"
    if count.ids < count.rows:  # each row gets a number of its own, in the order in which one of a group stays
        key = "_row"
        order = (F.col("doc_id").asc_nulls_last(), F.xxhash64(*COLUMNS), F.col("_any"))
        docs = docs.select(*COLUMNS, F.rand(7).alias("_any")).sort(*order).select(*COLUMNS, F.monotonically_increasing_id().alias(key))
        rows = Staged(docs, "rows")
        _LEFT.append(rows)
        docs = rows.read()
    working: list[Staged] = []
    found = near_dup.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"), words=5, percent=80, left=working)
    gone = Staged(found.where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct(), "gone")
    _LEFT.append(gone)
    for t in working:
        t.drop()
    gone = gone.read()
    if gone.count() <= near_dup.MOST_BROADCAST:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes that a document with a smaller doc_id has in a string of 50 go."""
    _begin(spark, docs)
    cut = exact_dedup.cut(docs, 50, ("lang", "source", "n_chars"), with_text=True, block_bytes=1 << 20, shard_bytes=2 << 20, left=_LEFT)
    n_chars = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    return cut.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: a row for each piece of a document, with its bin."""
    _begin(spark, docs)
    counted = Staged(packing.with_token_counts(docs, queries.tokenizer_file("byte_bpe_50k.json"), table=300_000, at_once=1 << 19, keep_table=False), "counted")
    _LEFT.append(counted)
    return packing.pack_sequences(counted.read(), "n_ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good_texts),
    ("quality_classifier", keep_good_sites),
    ("near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack_sequences),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again; a stage's documents go once the next one's are written."""
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        written = Staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            before.drop()
        docs, before = written.read(), written
    _drop_left(spark)
    return docs
