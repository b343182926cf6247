"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of the model goes on past a white-space marker, merges never cross
one, so a text's ids are those of its marked words joined by position. Each
distinct marked word of a batch is segmented once and kept in a bounded table. A
model with other pieces or a normaliser of its own is given whole texts instead.

Defined results: null counts as empty, an empty text has no ids and decodes to
the empty text; texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from blockstrata.llm._base import TABLES, clashing, small_batches, strings, tidied

_MARK = "▁"
_CHUNK = re.compile(" +[^ ]*")
_TABLES: dict[str, ChunkTable] = {}
TABLES.append(_TABLES.clear)


class ChunkTable:
    """Of each distinct marked word: its ids as decimal text, how many, and what they decode to."""

    def __init__(self, path: str, most: int = 250_000) -> None:
        import sentencepiece

        self.model, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "  é① ﬁ á　b  "
        plain = self.model.decode(self.model.encode(probe)) == probe and self.model.encode("a")[:1] == self.model.encode("a b")[:1]
        self.whole = not plain or any(re.search(f"[^{_MARK}]{_MARK}", p) for p in pieces)
        self.known: dict[str, tuple[bytes, str]] = {}

    @staticmethod
    def of(path: str) -> ChunkTable:
        if path not in _TABLES:
            _TABLES[path] = ChunkTable(path)
        return _TABLES[path]

    def _learn(self, chunks: Iterable[str]) -> None:
        """A chunk is one or more spaces (the first is the model's own leading marker) and a word."""
        new = [c for c in chunks if c not in self.known]
        if new:
            coded = self.model.encode([c[1:] for c in new], num_threads=1)
            back = self.model.decode(coded, num_threads=1)
            # the library gives no ids for an empty text; a lone marker is met by encoding it as a text of its own
            for c, ids, text in zip(new, coded, back, strict=True):
                self.known[c] = (",".join(map(str, ids)).encode(), " " + text) if ids else self._lone(c)

    def _lone(self, chunk: str) -> tuple[bytes, str]:
        ids = self.model.piece_to_id(_MARK * len(chunk))
        return str(ids).encode(), chunk

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as decimals joined by commas, decoded text) of each text."""
        if self.whole:
            coded = self.model.encode(texts, num_threads=1)
            return [(",".join(map(str, x)).encode(), y) for x, y in zip(coded, self.model.decode(coded, num_threads=1), strict=True)]
        if len(self.known) > self.most:
            self.known.clear()
        split = []
        for text in texts:
            if not text:
                split.append([])
                continue
            text = " " + text.replace(_MARK, " ")
            split.append(_CHUNK.findall(text) if "  " in text or text[-1] == " " else [" " + w for w in text[1:].split(" ")])
        self._learn({c for s in split for c in s})
        get, out = self.known.__getitem__, []
        for s in split:
            found = list(map(get, s))
            out.append((b",".join([x[0] for x in found]), "".join([x[1] for x in found])[1:]))
        return out


def encode(df: DataFrame, model: str, text: str = "text", rows: int = 256) -> DataFrame:
    """``df`` with ``ids`` (array of int) of each text."""
    kept = clashing(df, "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable.of(model)
        for batch in small_batches(batches, rows):
            coded = [np.array(ids.split(b","), np.int32) if ids else np.zeros(0, np.int32) for ids, _ in table.encode(strings(batch.column(text)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(coded, pa.list_(pa.int32()))], [*batch.schema.names, "ids"])

    return kept.mapInArrow(tidied(run, keep_tables=True), T.StructType([*kept.schema, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, model: str, ids: str = "ids", rows: int = 256) -> DataFrame:
    """``df`` with ``decoded``, the library's text for any ids; null counts as none."""
    kept = clashing(df, "decoded")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable.of(model)
        for batch in small_batches(batches, rows):
            texts = table.model.decode([x or [] for x in batch.column(ids).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return kept.mapInArrow(tidied(run, keep_tables=True), T.StructType([*kept.schema, T.StructField("decoded", T.StringType())]))


def digests(docs: DataFrame, model: str, rows: int = 256) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each of ``docs`` (doc_id, text), encoded and decoded in one pass."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable.of(model)
        for batch in small_batches(batches, rows):
            found = table.encode(strings(batch.column(1)))
            count = [ids.count(b",") + 1 if ids else 0 for ids, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in found]), pa.array([hashlib.sha256(y.encode()).hexdigest() for _, y in found])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run, keep_tables=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
