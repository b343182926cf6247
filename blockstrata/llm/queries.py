"""The thin queries of the operators, and the SQL of those that SQL can express.

Each takes whole tables and gives the whole result. Tokenizer files are a parameter of
the operators; the queries take them from the installed ``public_tokenizers``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata.llm import _ngrams, ann, chat, exact_dedup, near_dup, packing, pieces, quality_rules, sharding, site_quality, token_files
from blockstrata.llm._base import Staged, small_transfers


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_transfers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of near equal bytes; equal texts stay together unless their group outweighs a range."""
    text = F.coalesce("text", F.lit(""))
    rows = Staged(table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("text_hash")), "op1").read()
    out = sharding.shard(rows, "text_hash", "doc_id", "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = Staged(token_files.files(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")), "op4").read()
    return token_files.documents(written)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_back(chat.windows(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op4_token_files": op4_token_files,
    "op6_sentencepiece": op6_sentencepiece,
    "op9_chat": op9_chat,
}

#: The windows of chat.py with its default budgets: a stretch of 512 tokens, a history of 128 tokens and two turns.
_OP9 = r"""
WITH t0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t1 AS (SELECT *, row_number() OVER w AS pos,
    length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|<SYS>>|</SYS>>)', '\1\\\2', 'g'), '(\[)(/?INST\])', '\1\\\2', 'g'))
      + length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1 AS chars
  FROM t0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
t2 AS (SELECT *, CASE WHEN pos = 1 AND role = 'system' THEN 0 ELSE (strlen(text) + 3) // 4 + 4 END AS tokens FROM t1),
t3 AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM t2),
t4 AS (SELECT *, upto - tokens AS since, greatest(upto - 1, 0) // 512 AS stretch FROM t3),
t5 AS (SELECT *, stretch * 2 + CASE WHEN since >= stretch * 512 THEN 1 ELSE 0 END AS win FROM t4),
t6 AS (SELECT *, coalesce(lag(win) OVER w, -1) <> win AS opens,
    first_value(CASE WHEN role = 'system' THEN chars END) OVER w AS kept,
    CASE WHEN since - lag(since, 1) OVER w <= 128 AND NOT (pos = 2 AND first_value(role) OVER w = 'system') THEN lag(chars, 1) OVER w END AS past1,
    CASE WHEN since - lag(since, 2) OVER w <= 128 AND NOT (pos = 3 AND first_value(role) OVER w = 'system') THEN lag(chars, 2) OVER w END AS past2
  FROM t5 WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens AND pos > 1 THEN coalesce(kept, 0) + coalesce(past1, 0) + coalesce(past2, 0) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t6 GROUP BY conv_id"""

ORACLE: dict[str, str] = {"op9_chat": _OP9}


def quality_model(spark: SparkSession, sf_dir: str) -> object:
    """The n-gram model of the labelled documents; quality_rules and site_quality each train their own."""
    return _ngrams.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), keep=["doc_id"])


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.judge(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), keep=["doc_id", "source", "lang"])


QUERIES |= {"op3_quality_rules": op3_quality_rules, "op10_site_quality": op10_site_quality}


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


QUERIES["op7_near_dup"] = op7_near_dup

#: All pairs that share a shingle, counted exactly; components by a recursive walk.
ORACLE["op7_near_dup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * c >= 85 * (sx.n + sy.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN comp ON comp.x = d.doc_id"""


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(ann.build(table(spark, sf_dir, "embeddings")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, packed into sequences of 1,024 to 8,192."""
    counted = Staged(packing.with_token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")), "op2").read()
    return packing.pack_sequences(counted, "n_ids")


QUERIES |= {"op8_ann": op8_ann, "op2_packing": op2_packing}


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.cut(table(spark, sf_dir, "documents"), 50)


QUERIES["op5_exact_dedup"] = op5_exact_dedup

#: Windows of 50 bytes as 100 hexadecimal digits; runs of removed bytes as gaps and islands.
ORACLE["op5_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(strlen(h) // 2 - 49, 0))) AS i, h FROM d),
win AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 100)) AS a, hash(substr(h, 2 * i + 1, 100) || 'x') AS b FROM w),
least AS (SELECT a, b, min(doc_id) AS m FROM win GROUP BY a, b),
bad AS (SELECT doc_id, i FROM win JOIN least USING (a, b) WHERE m < doc_id),
mark AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM bad),
runs AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM mark GROUP BY doc_id, g),
joined AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM runs),
isle AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM joined),
spans AS (SELECT doc_id, k, min(s) AS s, max(e) AS e FROM isle GROUP BY doc_id, k),
gaps AS (SELECT doc_id, s, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS a, s AS b FROM spans
  UNION ALL SELECT doc_id, 1000000000, max(e), 1000000000 FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY s) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(strlen(d.h) // 2 AS BIGINT) AS n_bytes,
  CAST(coalesce((SELECT sum(e - s) FROM spans WHERE spans.doc_id = d.doc_id), 0) AS BIGINT) AS n_removed,
  CAST((SELECT count(*) FROM spans WHERE spans.doc_id = d.doc_id) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
