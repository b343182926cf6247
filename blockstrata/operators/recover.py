"""What can be saved of damaged files: runs of good blocks, and blocks that were torn apart and fit together again.

Candidates lie eight bytes before each sync word and count only with a right size, trailer
and checksum. Contiguous ones are a part. A block torn between two parts is found by joining
the end of one with the start of another at each place until framing and checksum agree.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockstrata.sources import datasource
from blockstrata.sources.framing import OVERHEAD, SYNC
from blockstrata.sources.shared import settled

#: Torn blocks are looked for up to this size.
MAX_GLUED = 1 << 20


@dataclass
class Part:
    """Good blocks one behind the other: ``offset`` to ``end``; the words before and after may be a torn block's sizes."""

    offset: int
    end: int
    blocks: list[tuple[int, int, int]] = field(default_factory=list)  # offset, size, group


@dataclass
class Glue:
    """A block out of what lies before ``right`` and behind ``left``, torn after ``split`` bytes."""

    left: int
    right: int
    size: int
    split: int


def candidates(data: bytes, accept_zero: bool = False) -> Iterator[tuple[int, int, int]]:
    """(offset, size, group) of every block that is whole, wherever it lies; a checksum of 0 counts only if accepted."""
    at = data.find(SYNC, 8)
    while at >= 0:
        start = at - 8
        size, group = struct.unpack_from(">II", data, start)
        if size >= OVERHEAD and start + size <= len(data):
            crc, again = struct.unpack_from(">II", data, start + size - 8)
            if again == size and (accept_zero and crc == 0 or crc == zlib.crc32(memoryview(data)[start : start + size - 8])):
                yield start, size, group
        at = data.find(SYNC, at + 1)


def parts(data: bytes, accept_zero: bool = False) -> list[Part]:
    out: list[Part] = []
    for offset, size, group in candidates(data, accept_zero):
        if out and offset < out[-1].end:
            continue
        if not out or out[-1].end != offset:
            out.append(Part(offset, offset))
        out[-1].blocks.append((offset, size, group))
        out[-1].end = offset + size
    return out


#: Up to so many bytes in all each split is simply tried.
_DIRECT = 1 << 20
#: The checksum's polynomial, lowest power in the highest bit.
_POLYNOMIAL = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over two elements, modulo the checksum's."""
    a, b = np.broadcast_arrays(a, b)
    out, b = np.zeros(a.shape, np.uint32), b.copy()
    for bit in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(bit) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLYNOMIAL, np.uint32(0))
    return out


def _powers(n: int) -> np.ndarray:
    """By how much a checksum is multiplied when 0, 1, ... n bytes follow."""
    out, byte = np.array([0x80000000], np.uint32), np.array([0x00800000], np.uint32)  # 1, and x to the eighth
    while len(out) <= n:
        out = np.concatenate([out, _times(out, byte)])
        byte = _times(byte, byte)
    return out[: n + 1]


def _running(data: bytes) -> np.ndarray:
    """Checksums of the first 0, 1, ... bytes."""
    out, crc = np.zeros(len(data) + 1, np.uint32), 0
    for i in range(len(data)):
        out[i + 1] = crc = zlib.crc32(data[i : i + 1], crc)
    return out


def try_glue(left: bytes, right: bytes, size: int, offset: int = 0, mod: int = 0) -> int | None:
    """Where ``left``'s start and ``right``'s end make a block of a size, or None; ``mod`` allows only splits at multiples of it in the file.

    The checksum of each join comes from those of the two pieces, so the work grows with the size, not with its square.
    """
    if not OVERHEAD <= size <= MAX_GLUED:
        return None
    left, right = left[:size], right[-size:]
    low, high = max(1, size - len(right)), min(size - 1, len(left))
    if low > high:
        return None
    right = bytes(size - len(right)) + right  # at the places that it has in a block
    frame = np.arange(low, high + 1)  # splits that keep the header's and the trailer's words right
    for at, word in ((0, struct.pack(">I", size)), (8, SYNC), (size - 4, struct.pack(">I", size))):
        for k in range(4):
            mine, theirs = at + k < len(left) and left[at + k] == word[k], right[at + k] == word[k]
            frame = frame[np.where(at + k < frame, mine, theirs)]
    if mod:
        frame = frame[(offset + frame) % mod == 0]
    if not len(frame):
        return None
    body = size - 8
    if len(frame) * size <= _DIRECT:
        for split in frame.tolist():
            whole = left[:split] + right[split:]
            if zlib.crc32(whole[:body]) == struct.unpack_from(">I", whole, body)[0]:
                return split
        return None
    powers, one, two = _powers(body), _running(left[:body]), _running(right[:body])
    cut = np.minimum(frame, body)
    behind = two[body] ^ _times(powers[body - cut], two[cut])  # of the second piece alone
    crc = _times(powers[body - cut], one[np.minimum(cut, len(one) - 1)]) ^ behind
    for split, found in zip(frame.tolist(), crc.tolist(), strict=True):
        if found == struct.unpack(">I", bytes((left if body + k < split else right)[body + k] for k in range(4)))[0]:
            return split
    return None


@dataclass
class Recovered:
    parts: list[Part]
    glued: list[Glue]

    def to_json(self) -> str:
        return json.dumps({"parts": [{"offset": p.offset, "size": p.end - p.offset, "blocks": [{"offset": o, "size": s, "group": g} for o, s, g in p.blocks]} for p in self.parts], "glued": [{"id": i, "left": g.left, "right": g.right, "size": g.size, "split": g.split} for i, g in enumerate(self.glued)]})


def recover(data: bytes, mod: int = 0, accept_zero: bool = False) -> Recovered:
    """All parts, and blocks torn between neighbours or, failing that, between any two."""
    found = parts(data, accept_zero)
    behind = [data[p.end : q.offset if q else len(data)] for p, q in zip(found, [*found[1:], None], strict=True)]
    before = [data[p.end if p else 0 : q.offset] for p, q in zip([None, *found[:-1]], found, strict=True)]
    glued, used_left, used_right = [], set(), set()

    def attempt(i: int, j: int) -> None:
        if i in used_left or j in used_right or len(behind[i]) < 4 or len(before[j]) < 4:
            return
        # both size words must agree before any checksum is worth computing
        size = struct.unpack_from(">I", behind[i])[0]
        if size != struct.unpack_from(">I", before[j], len(before[j]) - 4)[0]:
            return
        split = try_glue(behind[i], before[j], size, found[i].end, mod)
        if split is not None:
            glued.append(Glue(i, j, size, split))
            used_left.add(i)
            used_right.add(j)

    for i in range(len(found) - 1):
        attempt(i, i + 1)
    for i in range(len(found)):
        for j in range(len(found)):
            if i != j:
                attempt(i, j)
    return Recovered(found, glued)


# ---- the same over tables: files or pieces of them as rows (file, content) ----


def good_blocks(files: DataFrame, accept_zero: bool = False) -> DataFrame:
    """file, offset, size, group of every whole block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(candidates(content or b"", accept_zero))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), *(pa.array(x, pa.int64()) for x in zip(*found, strict=True))], ["file", "offset", "size", "group"])

    return files.select(F.col("file").cast("string"), "content").mapInArrow(run, "file string, offset long, size long, group long")


def islands(blocks: DataFrame) -> DataFrame:
    """Blocks (file, offset, size) with ``part``: the number of their run of contiguous blocks in the file, from 0."""
    order = Window.partitionBy("file").orderBy("offset")
    fresh = F.when(F.coalesce(F.lag(F.col("offset") + F.col("size")).over(order), F.lit(-1)) != F.col("offset"), 1).otherwise(0)
    return blocks.withColumn("_new", fresh).withColumn("part", (F.sum("_new").over(order) - 1).cast("long")).drop("_new")


def part_table(blocks: DataFrame) -> DataFrame:
    """file, part, offset, end, blocks: a row a part."""
    return islands(blocks).groupBy("file", "part").agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("size")).alias("end"), F.count("*").alias("blocks"))


def part_json(blocks: DataFrame) -> DataFrame:
    """file, json: each file's parts as text."""
    rows = islands(blocks).groupBy("file", "part").agg(F.sort_array(F.collect_list(F.struct("offset", "size", "group"))).alias("blocks"))
    return rows.groupBy("file").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("part", "blocks"))).alias("parts"))).alias("json"))


def glued(spark: SparkSession, path: str, mod: int = 0, partition_bytes: int = 64 << 20) -> DataFrame:
    """file, left, right, size, split: blocks torn between two parts of each file of a folder, by part numbers.

    Nothing is read but runs of bytes: blocks are found in splits, parts by their offsets, and only the bytes behind
    and before a part, up to the largest block that may be torn, are read again. Neighbours are tried first; of what
    is left, parts whose size words are equal meet, and each end and start is used once, lowest numbers first.
    """
    read = datasource.read(spark, path, table="blocks", split="true", partition_bytes=partition_bytes)
    whole = read.where("crc_ok AND crc <> 0").select("file", "offset", "size", "group")
    order = Window.partitionBy("file").orderBy("part")
    part = part_table(whole).withColumn("from", F.coalesce(F.lag("end").over(order), F.lit(0))).withColumn("to", F.lead("offset").over(order))

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with open(r["file"], "rb") as f:
                    end = r["to"] if r["to"] is not None else f.seek(0, 2)
                    f.seek(r["end"])
                    behind = f.read(min(4, end - r["end"]))
                    f.seek(max(r["from"], r["offset"] - 4))
                    before = f.read(min(4, r["offset"] - r["from"]))
                size = lambda word: int.from_bytes(word, "big") if len(word) == 4 and OVERHEAD <= int.from_bytes(word, "big") <= MAX_GLUED else None
                out.append((r["file"], r["part"], r["offset"], r["end"], r["from"], end, size(behind), size(before)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string(), *[pa.int64()] * 7], strict=True)], ["file", "part", "offset", "end", "from", "to", "behind", "before"])

    ends = settled(part.select("file", "part", "offset", "end", "from", "to").mapInArrow(words, "file string, part long, offset long, end long, from long, to long, behind long, before long"))
    left = ends.where("behind IS NOT NULL").select("file", F.col("behind").alias("size"), F.col("part").alias("left"), "end", "to")
    right = ends.where("before IS NOT NULL").select("file", F.col("before").alias("size"), F.col("part").alias("right"), "from", F.col("offset").alias("until"))
    columns = ["file", "size", "left", "right", "end", "to", "from", "until"]
    beside = left.withColumn("right", F.col("left") + 1).join(right, ["file", "size", "right"]).select(*columns)

    def attempt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                with open(r["file"], "rb") as f:
                    f.seek(r["end"])
                    one = f.read(min(r["size"], r["to"] - r["end"]))
                    f.seek(max(r["from"], r["until"] - r["size"]))
                    two = f.read(r["until"] - f.tell())
                if (split := try_glue(one, two, r["size"], r["end"], mod)) is not None:
                    out.append((r["file"], r["left"], r["right"], r["size"], split))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.string(), *[pa.int64()] * 4], strict=True)], ["file", "left", "right", "size", "split"])

    schema = "file string, left long, right long, size long, split long"
    found = settled(beside.mapInArrow(attempt, schema))
    rest = left.join(found.select("file", "left"), ["file", "left"], "left_anti").join(right.join(found.select("file", "right"), ["file", "right"], "left_anti"), ["file", "size"]).where("left <> right AND right <> left + 1").select(*columns)
    first = lambda side, other: F.row_number().over(Window.partitionBy("file", side).orderBy(other))
    far = rest.mapInArrow(attempt, schema).withColumn("_l", first("left", "right")).withColumn("_r", first("right", "left")).where("_l = 1 AND _r = 1").drop("_l", "_r")
    return found.unionByName(far)
