"""Queries over the standard tables that go through the engine: encode, frame, decode, operate; each with its SQL.

``events`` is a time history: event_id numbers its rows, B of them make a block. Blocks are
built from table rows, framed and decoded again, so what an operator sees has been through
bytes and programs.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockstrata.functions import expr, text
from blockstrata.operators import crush, groups, recover, rows, sift
from blockstrata.operators.histogram import histogram
from blockstrata.plans.program import Program, compile_decoder
from blockstrata.sources.catalog import Catalog, Transform, find_tag
from blockstrata.sources.datasource import metadata_rows
from blockstrata.sources.decoding import decode_blocks, frame, unframe
from blockstrata.sources.framing import BlockFile, encode, index_payload, read_index
from blockstrata.sources.writer import Writer
from blockstrata.sources.xml import parse
from blockstrata.streaming.ingest import parse_chunks

B = 512
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def program(body: str) -> Program:
    return compile_decoder(parse(f"<decoder>{body}</decoder>"))


#: A block: the number of its first row, then a value a row.
HISTORY = program('<read var="v0" bits="64" type="uint" endian="little"/><loop><read var="v1" bits="64" type="float" endian="little"/><sample/><set var="v0" value="{$v0 + 1}"/></loop>')
#: The same with the row's number counted by the loop, which decodes as a whole.
TIMED = program('<read var="start" bits="64" type="uint" endian="little"/><loop var="n" start="0"><read var="v1" bits="64" type="float" endian="little"/><set var="v0" value="{$start + $n}"/><sample/></loop>')


def packed(source: DataFrame, key: Column, order: Column, value: Column, kind: str = "<f8", head: str = "<Q", size: int = B) -> DataFrame:
    """block, payload: ``size`` consecutive keys make a block of a header (the first key) and values in order."""
    rows_ = source.select((F.floor(key / size)).cast("long").alias("block"), order.cast("long").alias("o"), value.cast("double").alias("v"))
    grouped = rows_.groupBy("block").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("values"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [struct.pack(head, b * size) + v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for b, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "payload"])

    return grouped.mapInArrow(run, "block long, payload binary")


def framed(blocks: DataFrame, group: int = 2) -> DataFrame:
    """Through framing and back: block, group, payload, size, crc, ok."""
    return blocks.select("block", unframe(frame(F.lit(group), F.col("payload"))).alias("b")).select("block", "b.*")


def history(spark: SparkSession, sf_dir: str, vectorised: bool = True) -> DataFrame:
    """events as rows: block, scan, dim0 (event_id), dim1 (value)."""
    e = table(spark, sf_dir, "events")
    return decode_blocks(framed(packed(e, F.col("event_id"), F.col("event_id"), F.col("value"))), TIMED if vectorised else HISTORY, vectorised=vectorised)


_ROWS = f"SELECT event_id // {B} AS block, event_id % {B} AS scan, CAST(event_id AS DOUBLE) AS dim0, value AS dim1 FROM events"


@query(_ROWS)
def channel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir)


@query(_ROWS)
def channel_scan_rowwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by generated code, row by row."""
    return history(spark, sf_dir, vectorised=False)


_KINDS = {"u8": ("uint", 8, "u1"), "i8": ("int", 8, "i1"), "u16": ("uint", 16, "u2"), "i16": ("int", 16, "i2"), "u32": ("uint", 32, "u4"), "i32": ("int", 32, "i4"), "u64": ("uint", 64, "u8"), "i64": ("int", 64, "i8"), "f32": ("float", 32, "f4"), "f64": ("float", 64, "f8")}


def _read_types(endian: str) -> None:
    """One query for each number type: p_size (less 25 for signed ones, as price for floats) written and read as it."""
    for name, (kind, bits, code) in _KINDS.items():
        value = "p_retailprice" if kind == "float" else "p_size - 25" if kind == "int" else "p_size"
        body = f'<read var="v0" bits="64" type="uint" endian="little"/><loop><read var="v1" bits="{bits}" type="{kind}" endian="{endian}"/><sample/><set var="v0" value="{{$v0 + 1}}"/></loop>'
        order = "<" if endian == "little" else ">"

        def run(spark: SparkSession, sf_dir: str, value: str = value, body: str = body, code: str = order + code) -> DataFrame:
            part = table(spark, sf_dir, "part")
            blocks = packed(part, F.col("p_partkey"), F.col("p_partkey"), F.expr(value), code)
            first = table(spark, sf_dir, "part").agg(F.min("p_partkey")).first()[0] or 0
            out = decode_blocks(framed(blocks), program(body))
            return out.select("block", "scan", F.col("dim1").alias("value")).withColumn("scan", F.col("scan") + F.when(F.col("block") == first // B, first % B).otherwise(0))

        shown = f"CAST(CAST({value} AS FLOAT) AS DOUBLE)" if name == "f32" else f"CAST({value} AS DOUBLE)"
        run.__name__ = f"read_{name}_{endian}"
        query(f"SELECT p_partkey // {B} AS block, p_partkey % {B} AS scan, {shown} AS value FROM part")(run)


_read_types("little")
_read_types("big")

#: A message: its size, a byte of flags (1: no id, 2: no text), the id and the text's bytes.
MESSAGES = program(
    '<loop><read var="size" bits="32" type="uint" endian="big"/><read var="v0" bits="8" type="uint"/><read var="v1" bits="64" type="int" endian="big"/><read var="v2" octets="{$size - 13}" type="raw"/><sample/></loop>'
)
#: Numbers of varying length: a byte says how many pairs of decimal digits follow, a byte each, the last pair first. Then a text behind its length.
DIGITS = program(
    '<loop><read var="pairs" bits="8" type="uint"/><set var="v0" value="0"/><set var="unit" value="1"/><loop var="k" start="0" end="{$pairs}"><read var="pair" bits="8" type="uint"/><set var="v0" value="{$v0 + $unit * $pair}"/><set var="unit" value="{$unit * 100}"/></loop>'
    '<read var="length" bits="16" type="uint" endian="little"/><read var="v1" octets="{$length}"/><sample/></loop>'
)


@query("SELECT doc_id, strlen(text) AS bytes, md5(text) AS digest FROM documents")
def message_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as messages of computed length, 16 rows to a block; null ids and texts are flagged and come back as nulls.

    Rows are dealt by position, so rows that repeat an id or have none never meet in one block.
    """
    part = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    word = lambda n, digits: F.unhex(F.lpad(F.hex(n), digits, "0"))
    flags = F.isnull("doc_id").cast("int") + 2 * F.isnull("text").cast("int")
    message = F.concat(word(F.octet_length(part) + 13, 8), word(flags, 2), word(F.coalesce("doc_id", F.lit(0)), 16), part)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.shiftright(F.monotonically_increasing_id(), 4).alias("block"))
    blocks = docs.groupBy("block").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", message.alias("m")))), lambda x: F.hex(x["m"])), "")).alias("payload"))
    out = decode_blocks(framed(blocks), MESSAGES)
    has = lambda flag, value: F.when(F.col("dim0").cast("int").bitwiseAND(flag) == 0, value)
    return out.select(has(1, F.col("dim1").cast("long")).alias("doc_id"), has(2, F.octet_length("dim2").cast("long")).alias("bytes"), has(2, F.md5("dim2")).alias("digest"))


@query("SELECT user_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, min(event_type) AS first_type FROM events GROUP BY user_id")
def message_varint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids as pairs of decimal digits, as many as there are, and types as raw bytes, a block a user."""
    e = table(spark, sf_dir, "events")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for items in batch.column(1).to_pylist():
                data = b""
                for item in items:
                    shown, name = str(item["event_id"]), item["event_type"].encode()
                    shown = "0" * (len(shown) % 2) + shown
                    pairs = bytes(int(shown[i : i + 2]) for i in range(len(shown) - 2, -1, -2))
                    data += bytes([len(pairs)]) + pairs + struct.pack("<H", len(name)) + name
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "payload"])

    blocks = e.groupBy(F.col("user_id").alias("block")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("items")).mapInArrow(run, "block long, payload binary")
    out = decode_blocks(blocks, DIGITS)
    return out.groupBy(F.col("block").alias("user_id")).agg(F.count("*").alias("n"), F.sum(F.col("dim0").cast("long")).alias("ids"), F.min(F.decode("dim1", "UTF-8")).alias("first_type"))


BITS = program(
    '<read var="v0" bits="64" type="uint" endian="little"/><read var="count" bits="32" type="uint" endian="little"/><loop var="i" end="{$count}"><if condition="{!($i &amp; 7)}"><read var="byte" bits="8" type="uint"/></if>'
    '<set var="v1" value="{(($byte >> (7 - ($i &amp; 7))) &amp; 1)}"/><sample/><set var="v0" value="{$v0 + 1}"/></loop>'
)


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS DOUBLE) AS bit FROM orders")
def bit_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as single bits, unpacked by shifts."""
    orders = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 1024).alias("block"), "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("bit"))
    grouped = orders.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "bit"))).alias("items"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for items in batch.column(1).to_pylist():
                base = items[0]["o_orderkey"]
                bits = np.zeros(items[-1]["o_orderkey"] - base + 1, np.uint8)
                bits[[i["o_orderkey"] - base for i in items]] = [i["bit"] for i in items]
                out.append(struct.pack("<QI", base, len(bits)) + np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["block", "payload"])

    out = decode_blocks(grouped.mapInArrow(run, "block long, payload binary"), BITS)
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    return out.select(F.col("dim0").cast("long").alias("o_orderkey"), F.col("dim1").alias("bit")).join(keys, "o_orderkey")


@query(f"SELECT event_id // {B} AS block, event_id % {B} AS scan, CAST(event_id AS DOUBLE) * 0.02 + 1.5 AS dim0, value * 0.1 + (-3.25) AS dim1 FROM events")
def xform_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.transformed(history(spark, sf_dir), {0: Transform("linear", 0.02, 1.5), 1: Transform("linear", 0.1, -3.25)})


_MAP = [100.0, 101.5, 103.0, 104.5, 106.0, 107.5, 109.0, 110.5, 112.0, 113.5, 115.0, 116.5, 118.0, 119.5, 121.0, 122.5, 124.0, 125.5, 127.0, 128.5]


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN 100 + 1.5 * p_size ELSE CAST(p_size AS DOUBLE) END AS dim1 FROM part")
def xform_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("dim1"))
    return rows.transformed(part, {1: Transform("map", table=_MAP)})


@query("SELECT p_partkey, coalesce(n_regionkey, CAST(p_size AS DOUBLE)) AS dim1 FROM part LEFT JOIN nation ON n_nationkey = p_size")
def xform_index_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup in another channel's dimension by row number, as a join."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("dim1"))
    nation = table(spark, sf_dir, "nation").select(F.lit(0).cast("long").alias("block"), F.col("n_nationkey").cast("long").alias("scan"), F.col("n_regionkey").cast("double").alias("dim0"))
    return rows.transformed(part, {1: Transform("index", index_channel=7, index_dim=0)}, {7: nation})


@query(f"SELECT event_id // {B} AS block, event_id % {B} AS scan, CAST(NULL AS DOUBLE) AS dim0, value AS dim1, CAST(event_id AS DOUBLE) AS dim2, value AS dim3 FROM events")
def combine_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = history(spark, sf_dir).withColumnsRenamed({"dim0": "v0", "dim1": "v1"})
    return rows.combine(raw, [None, 1, 0, 1])


_OPS = {
    "div": ("{$a / $b}", "CASE WHEN l_linenumber - 2 = 0 THEN 0.0 ELSE l_quantity / (l_linenumber - 2) END"), "conj": ("{$q & 12}", "CAST(CAST(l_partkey AS BIGINT) & 12 AS DOUBLE)"), "disj": ("{$q | 5}", "CAST(CAST(l_partkey AS BIGINT) | 5 AS DOUBLE)"),
    "lsl": ("{$q << 3}", "CAST(CAST(l_partkey AS BIGINT) * 8 AS DOUBLE)"), "lsr": ("{$q >> 2}", "CAST(CAST(l_partkey AS BIGINT) >> 2 AS DOUBLE)"), "neg": ("{!($b)}", "CASE WHEN l_linenumber - 2 = 0 THEN 1.0 ELSE 0.0 END"),
    "lt": ("{$a < 20}", "CASE WHEN l_quantity < 20 THEN 1.0 ELSE 0.0 END"), "ge": ("{$a >= 20}", "CASE WHEN l_quantity >= 20 THEN 1.0 ELSE 0.0 END"), "eq": ("{$a == 20}", "CASE WHEN l_quantity = 20 THEN 1.0 ELSE 0.0 END"), "ne": ("{$a != 20}", "CASE WHEN l_quantity <> 20 THEN 1.0 ELSE 0.0 END"),
    "le": ("{$a <= 20}", "CASE WHEN l_quantity <= 20 THEN 1.0 ELSE 0.0 END"), "gt": ("{$a > 20}", "CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0.0 END"), "land": ("{$b && ($a > 10)}", "CASE WHEN l_linenumber <> 2 AND l_quantity > 10 THEN 1.0 ELSE 0.0 END"), "lor": ("{!$b || ($a > 10)}", "CASE WHEN l_linenumber = 2 OR l_quantity > 10 THEN 1.0 ELSE 0.0 END"),
    "mix": ("{$a * 2 + $q - 1 / 4}", "l_quantity * 2 + l_partkey - 0.25"), "below": ("{(0 - $a) & 7}", "0.0"), "modulo": ("{$a % 7}", "l_quantity"),
}
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity"


@query(f"SELECT {_KEYS}, " + ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, (_, sql) in _OPS.items()) + " FROM lineitem")
def expr_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expression language as columns in JVM code."""
    named = {"a": F.col("l_quantity"), "b": F.col("l_linenumber") - 2, "q": F.col("l_partkey")}
    return table(spark, sf_dir, "lineitem").select(*_KEYS.split(", "), *(expr.column(e, named).alias(n) for n, (e, _) in _OPS.items()))


@query(f"SELECT {_KEYS}, " + ", ".join(f"CAST({_OPS[n][1]} AS DOUBLE) AS {n}" for n in ("div", "conj", "lsl", "land", "mix")) + " FROM lineitem")
def expr_ops_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operators run by a decoder program over encoded rows."""
    names = ["div", "conj", "lsl", "land", "mix"]
    keys = _KEYS.split(", ")
    reads = "".join(f'<read var="{"v" + str(i)}" bits="64" type="float" endian="little"/>' for i in range(5))
    escape = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("$a", "$v4").replace("$q", "$v1").replace("$b", "$less")
    sets = '<set var="less" value="{$v3 - 2}"/>' + "".join(f'<set var="v{5 + i}" value="{escape(_OPS[n][0])}"/>' for i, n in enumerate(names))
    lines = table(spark, sf_dir, "lineitem").select(*(F.col(k).cast("double") for k in keys))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1).astype("<f8").tobytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([0], pa.int64()), "payload": pa.array([data], pa.binary())})

    out = decode_blocks(lines.mapInArrow(run, "block long, payload binary"), program(f"<loop>{reads}{sets}<sample/></loop>"))
    kinds = dict(table(spark, sf_dir, "lineitem").dtypes)
    return out.select(*(F.col(f"dim{i}").cast(kinds[k]).alias(k) for i, k in enumerate(keys)), *(F.col(f"dim{5 + i}").alias(n) for i, n in enumerate(names)))


@query(f"SELECT event_id // {B} AS block, event_id % {B} AS scan, CAST(event_id AS DOUBLE) AS dim0, value AS dim1 FROM events WHERE (CASE WHEN value > 50 THEN 1 ELSE 0 END) <> 0")
def if_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history(spark, sf_dir)
    return rows.if_nonzero(out, expr.column("{$x > 50}", {"x": F.col("dim1")}))


def _bound(kind: str) -> None:
    for share in (0.0, 0.37, 1.0):
        name = f"{kind}_bound_{int(share * 100)}"

        def run(spark: SparkSession, sf_dir: str, share: float = share) -> DataFrame:
            out = history(spark, sf_dir)
            last = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
            return (rows.lower_bound if kind == "lower" else rows.upper_bound)(out, "dim0", share * last + 0.25)

        run.__name__ = name
        x = f"(SELECT {share} * max(event_id) + 0.25 FROM events)"
        pick, side = ("min", ">=") if kind == "lower" else ("max", "<=")
        query(f"SELECT m // {B} AS block, m % {B} AS scan FROM (SELECT {pick}(event_id) AS m FROM events WHERE event_id {side} {x}) WHERE m IS NOT NULL")(run)


_bound("lower")
_bound("upper")


@query(_ROWS + " WHERE event_id BETWEEN 700 AND 1900.5")
def zone_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in a range: what a block's header and length say of its first and last row leaves blocks out before they are decoded."""
    e = table(spark, sf_dir, "events")
    blocks = framed(packed(e, F.col("event_id"), F.col("event_id"), F.col("value"))).select("block", "payload")
    first = F.conv(F.hex(F.concat(*(F.substring("payload", 8 - i, 1) for i in range(8)))), 16, 10).cast("long")
    zone = blocks.select("block", first.alias("low"), (first + F.octet_length("payload") / 8 - 2).alias("high"))
    return rows.between(decode_blocks(rows.reaching(blocks, zone, 700, 1900.5), TIMED), "dim0", 700, 1900.5)


@query(_ROWS + f" WHERE event_id % {B} < 5")
def scan_limit_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.limit_scans(history(spark, sf_dir), 5)


@query(_ROWS + " ORDER BY event_id LIMIT 777")
def scan_limit_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.limit_total(history(spark, sf_dir), 777)


@query(f"SELECT event_id // {B} AS block, event_id % {B} - 10 AS scan, CAST(event_id AS DOUBLE) AS dim0, value AS dim1, CAST(10 AS BIGINT) AS scan_offset FROM events WHERE event_id % {B} >= 10 AND event_id % {B} < 35")
def trim_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.trim(history(spark, sf_dir), 10, 25)


@query(_ROWS + f" WHERE event_id // {B} >= 3")
def seek_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.seek(history(spark, sf_dir), 3)


@query("""WITH p AS (SELECT CAST(pow(2, min(k)) AS BIGINT) AS p FROM range(0, 60) t(k) WHERE (SELECT count(*) FROM events) < 2 * 100 * pow(2, k))
SELECT event_id // p AS bucket, CAST(min(event_id) AS DOUBLE) AS out0, CAST(max(event_id) AS DOUBLE) AS out1, min(value) AS out2, max(value) AS out3, count(*) AS n FROM events, p GROUP BY 1""")
def plot_crush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of the event values at about a hundred points."""
    return crush.crush(history(spark, sf_dir), 100)


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as histogram rows: count, then bounds of quantity (by five) and discount (by 0.02); later ones replace earlier."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.floor(F.col("l_quantity") / 5).alias("q"), F.floor(F.col("l_discount") * 50 + 1e-9).alias("d")).agg(F.count("*").alias("n"))
    lower, left = F.col("q").cast("double") * 5, F.col("d").cast("double")
    return lines.select(F.lit(0).cast("long").alias("block"), (F.col("q") * 100 + F.col("d")).alias("scan"), F.col("n").cast("double").alias("dim0"), lower.alias("dim1"), (lower + 5).alias("dim2"), left.alias("dim3"), (left + 1).alias("dim4"))


_CELLS = "SELECT CAST(floor(l_quantity / 5) AS BIGINT) AS q, CAST(floor(l_discount * 50 + 1e-9) AS BIGINT) AS d, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1, 2"


@query(f"""WITH c AS ({_CELLS}), q AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS i FROM (SELECT DISTINCT q FROM c)), d AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS j, count(*) OVER () AS n_d FROM (SELECT DISTINCT d FROM c))
SELECT i * n_d + j AS flat, i AS i0, j AS i1, coalesce(n, 0.0) AS value FROM q CROSS JOIN d LEFT JOIN c ON c.q = q.q AND c.d = d.d""")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(_binned(spark, sf_dir)).dense()


@query(f"WITH c AS ({_CELLS}), q AS (SELECT q, max(d) AS d FROM c GROUP BY q) SELECT row_number() OVER (ORDER BY q.q) - 1 AS i0, row_number() OVER (ORDER BY q.q) - 1 AS flat, n AS value FROM q JOIN c ON c.q = q.q AND c.d = q.d")
def histogram_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One axis; of the rows of a bin the last counts."""
    return histogram(_binned(spark, sf_dir).drop("dim3", "dim4")).bins


@query(f"WITH c AS ({_CELLS}) SELECT CAST(0 AS INTEGER) AS axis, row_number() OVER (ORDER BY q) - 1 AS bin, CAST(q * 5 AS DOUBLE) AS lower, CAST(q * 5 + 5 AS DOUBLE) AS upper FROM (SELECT DISTINCT q FROM c) UNION ALL SELECT 1, row_number() OVER (ORDER BY d) - 1, CAST(d AS DOUBLE), CAST(d + 1 AS DOUBLE) FROM (SELECT DISTINCT d FROM c)")
def histogram_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = histogram(_binned(spark, sf_dir)).axes
    return axes.select("axis", "bin", "lower", "upper")


@query(f"WITH c AS ({_CELLS}), q AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS i FROM (SELECT DISTINCT q FROM c)), d AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS j, count(*) OVER () AS n_d FROM (SELECT DISTINCT d FROM c)) SELECT i AS i0, j AS i1, i * n_d + j AS flat, n AS value FROM c JOIN q USING (q) JOIN d USING (d) WHERE n <> 0")
def histogram_nonzero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(_binned(spark, sf_dir)).nonzero()


def _type_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event values, a group an event type (2 and on, by name), blocks of 100."""
    e = table(spark, sf_dir, "events")
    kinds = sift.id_map(e.select("event_type"), "event_type", "event_type", 2).withColumnRenamed("new", "group")
    from pyspark.sql import Window

    numbered = e.join(kinds, "event_type").withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy("event_id")) - 1)
    cells = numbered.groupBy("group", F.floor(F.col("n") / 100).alias("block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [v.values.to_numpy(zero_copy_only=False).astype("<f8").tobytes() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["group", "block", "payload"])

    return cells.select("group", "block", "values").mapInArrow(run, "group long, block long, payload binary")


_TYPES = "WITH k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) + 1 AS g FROM (SELECT DISTINCT event_type FROM events)), n AS (SELECT g, value, row_number() OVER (PARTITION BY g ORDER BY event_id) - 1 AS n FROM events JOIN k USING (event_type)), b AS (SELECT g, n // 100 AS block, count(*) * 8 AS bytes FROM n GROUP BY 1, 2)"


@query(_TYPES + ' SELECT g AS "group", count(*) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes, false AS closed FROM b GROUP BY g')
def group_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_totals(_type_blocks(spark, sf_dir))


@query(_TYPES + " SELECT count(*) AS blocks, CAST(sum(bytes) AS BIGINT) AS payload_bytes, CAST(sum(bytes) + count(*) * 32 + ceil(count(*) / 5462) * 20 AS BIGINT) AS file_bytes FROM b")
def totals_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.written_size(_type_blocks(spark, sf_dir))


@query(_TYPES + ', s AS (SELECT g, block, bytes + 20 AS size FROM b) SELECT g AS "group", block, CAST(size AS BIGINT) AS size, CAST(coalesce(sum(size) OVER (PARTITION BY g ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM s')
def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group as a file of its own, written with one index behind all its blocks and read back from its end."""
    blocks = _type_blocks(spark, sf_dir).select("group", "block", "payload").repartition("group").sortWithinPartitions("group", "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[int, tuple[io.BytesIO, Writer]] = {}
        for batch in batches:
            for group, payload in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if group not in files:
                    file = io.BytesIO()
                    files[group] = file, Writer(file.write, flush=None)
                files[group][1].write_block(group, payload)
        for group, (file, writer) in files.items():
            writer.close()
            found = [e for e in BlockFile(file).index() if e.group == group]
            again = read_index(index_payload((e.offset, e.group) for e in found), found[-1].offset + found[-1].size)
            yield pa.RecordBatch.from_pydict({"group": pa.array([group] * len(again), pa.int64()), "block": pa.array(range(len(again)), pa.int64()), "size": pa.array([e.size for e in again], pa.int64()), "offset": pa.array([e.offset for e in again], pa.int64())})

    return blocks.mapInArrow(run, "group long, block long, size long, offset long")


@query(_TYPES + ', m AS (SELECT g, row_number() OVER (ORDER BY g DESC) + 9 AS new FROM k WHERE g IN (2, 4)) SELECT new AS "group", n.g AS old_group, n // 100 - 1 AS block, count(*) AS "rows", sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) :: BIGINT AS large FROM n JOIN m ON m.g = n.g WHERE n // 100 >= 1 AND n // 100 < 5 GROUP BY ALL')
def sift_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks 1 to 5 of two groups as groups 10 and 11, the second first; ranges asked for in two parts."""
    wanted = spark.createDataFrame([(0, 4, 1, 3), (1, 2, 1, 5), (2, 4, 2, 5)], "ord long, group long, start long, end long")
    kept = sift.sift_blocks(_type_blocks(spark, sf_dir), wanted, 10)
    values = decode_blocks(kept, program('<loop><read var="v0" bits="64" type="float" endian="little"/><sample/></loop>'), keys=("group", "old_group"))
    return values.groupBy("group", "old_group", "block").agg(F.count("*").alias("rows"), F.sum((F.col("dim0") > 50).cast("long")).alias("large"))


@query(_TYPES + " SELECT count(*) AS blocks, CAST(sum(bytes) AS BIGINT) AS payload_bytes, CAST(sum(bytes) + count(*) * 32 + ceil(count(*) / 5462) * 20 AS BIGINT) AS file_bytes FROM b WHERE g IN (2, 3) AND block < 4")
def sift_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(0, 2, 0, 4), (1, 3, 0, 4)], "ord long, group long, start long, end long")
    return sift.sifted_size(_type_blocks(spark, sf_dir), wanted)


@query(_TYPES + ", s AS (SELECT g, block, bytes + 20 AS size, sum(bytes + 20) OVER (PARTITION BY g ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM b), ok AS (SELECT g, block, size, coalesce(o, 0) AS o, block - row_number() OVER (PARTITION BY g ORDER BY block) AS run FROM s WHERE block % 3 <> 1), p AS (SELECT g, run, min(o) AS o, max(o + size) AS e, count(*) AS n FROM ok GROUP BY 1, 2) SELECT CAST(g AS VARCHAR) AS file, row_number() OVER (PARTITION BY g ORDER BY o) - 1 AS part, CAST(o AS BIGINT) AS \"offset\", CAST(e AS BIGINT) AS \"end\", n AS blocks FROM p")
def recover_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group as a file of which every third block is damaged; what is left, in parts."""
    bytes_ = frame(F.col("group"), F.col("payload"))
    damaged = F.when(F.col("block") % 3 == 1, F.concat(F.substr(bytes_, F.lit(1), F.octet_length(bytes_) - 1), F.unhex(F.lit("FF")))).otherwise(bytes_)
    files = _type_blocks(spark, sf_dir).groupBy(F.col("group").cast("string").alias("file")).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", damaged.alias("d")))), lambda x: F.hex(x["d"])), "")).alias("content"))
    return recover.part_table(recover.good_blocks(files))


def _catalog(spark: SparkSession, sf_dir: str, mode: str) -> Catalog:
    """Regions as base channels, nations as channels based on them, in the metadata language; a second tag and dimension where a nation's key is even."""
    from xml.sax.saxutils import escape

    regions = sorted(map(tuple, table(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()))
    nations = sorted(map(tuple, table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name").collect()))
    xml = "<sie>" + "".join(f'<ch id="{1000 + k}" private="1"><tag id="area">{escape(n)}</tag><dim index="0"><data decoder="2" v="0"/><xform scale="{k + 1}" offset="0"/></dim></ch>' for k, n in regions) + '<test id="0">'
    for k, r, name in nations:
        own = f'<tag id="area">{escape(name)}</tag><dim index="0"><xform scale="{k + 0.5}" offset="1"/></dim>' if k % 2 == 0 else ""
        xml += f'<ch id="{k}" base="{1000 + r}" name="{escape(name)}">{own}</ch>'
    return Catalog.of([xml.encode(), b"</test>"], mode)


def _tag_rows(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir, mode)
    out = [(c.id, c.name, find_tag(c.tags, "area", mode).value, c.dims[0].transform.scale) for c in catalog.channels]
    return spark.createDataFrame(out, "channel long, name string, area string, scale double")


@query("SELECT CAST(n_nationkey AS BIGINT) AS channel, n_name AS name, r_name AS area, CAST(r_regionkey + 1 AS DOUBLE) AS scale FROM nation JOIN region ON r_regionkey = n_regionkey")
def base_inherit_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tag_rows(spark, sf_dir, "reference")


@query("SELECT CAST(n_nationkey AS BIGINT) AS channel, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS area, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey + 0.5 ELSE CAST(r_regionkey + 1 AS DOUBLE) END AS scale FROM nation JOIN region ON r_regionkey = n_regionkey")
def base_inherit_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tag_rows(spark, sf_dir, "spec")


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir, "reference")
    return spark.createDataFrame(list(metadata_rows(catalog, "tags")), "file string, owner_kind string, owner_id long, dim_index long, ord long, key string, value string, group_id long, format string")


@query("SELECT 'channel' AS owner_kind, CAST(n_nationkey AS BIGINT) AS owner_id, 'area' AS key, r_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey")
def tag_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.first_tags(_tags(spark, sf_dir)).select("owner_kind", "owner_id", "key", "value")


@query("SELECT 'channel' AS owner_kind, CAST(n_nationkey AS BIGINT) AS owner_id, 'area' AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS value FROM nation JOIN region ON r_regionkey = n_regionkey")
def tag_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.first_tags(_tags(spark, sf_dir), "spec").select("owner_kind", "owner_id", "key", "value")


@query("SELECT page_id, split_part(split_part(url, '?', 1), '/', 3) AS host, len(string_split(split_part(url, '://', 2), '/')) - 1 AS parts FROM pages")
def relation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as name and value pairs between slashes."""
    found = text.pairs(F.replace(F.regexp_replace(F.split_part("url", F.lit("://"), F.lit(2)), "^", "host=/"), F.lit("host=/"), F.lit("host=")), "/", "=")
    pages = table(spark, sf_dir, "pages")
    slashes = F.length(F.split_part("url", F.lit("://"), F.lit(2))) - F.length(F.replace(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit("")))
    return pages.select("page_id", F.split_part(text.relation_value(found, "host"), F.lit("?"), F.lit(1)).alias("host"), slashes.cast("long").alias("parts"))


_PROPS = "replace(replace(replace(replace(props, '{', ''), '}', ''), '\"', ''), ' ', '')"


@query(f"SELECT event_id, TRY_CAST(split_part({_PROPS}, ':', 2) AS BIGINT) AS k, TRY_CAST(split_part({_PROPS}, ':', 2) AS DOUBLE) * 2 AS k2 FROM events")
def relation_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """props as name and value pairs, read as whole and as decimal numbers."""
    bare = F.regexp_replace("props", r'[{}"\s]', "")
    found = text.pairs(bare, ",", ":")
    return table(spark, sf_dir, "events").select("event_id", text.relation_int(found, "k").alias("k"), (text.relation_float(found, "k") * 2).alias("k2"))


@query("SELECT o_orderkey, TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) AS first, TRY_CAST(o_orderpriority AS DOUBLE) AS whole, CASE WHEN TRY_CAST(left(o_orderpriority, 1) AS DOUBLE) IS NULL THEN false ELSE true END AS numeric, nullif(strpos(o_orderpriority, '-'), 0) - 1 AS dash FROM orders")
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.to_number(F.left(p, F.lit(1))).alias("first"), text.to_number(p).alias("whole"), text.is_numeric(F.left(p, F.lit(1))).alias("numeric"), text.index_of(p, "-").cast("long").alias("dash"))


@query("SELECT p_brand, count(*) AS uses FROM part GROUP BY p_brand")
def intern_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.interned(table(spark, sf_dir, "part"), "p_brand")


@query("SELECT CAST(sum(c_custkey * 42 + c_nationkey) AS BIGINT) AS total, count(*) AS n FROM customer")
def id_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.sum(F.col("c_custkey") * 42 + F.col("c_nationkey")).alias("total"), F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_nationkey + 100 ELSE c_nationkey END :: BIGINT AS c_nationkey FROM customer")
def id_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("old"), (F.col("n_nationkey") + 100).cast("long").alias("new"))
    return sift.remap(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long")), "c_nationkey", ids).select("c_custkey", "c_nationkey")


@query(f"SELECT 'left' AS side, event_id // {B} AS block, count(*) AS n FROM events WHERE event_id % 1000 = 7 GROUP BY ALL UNION ALL SELECT 'right', event_id // {B}, count(*) FROM events WHERE event_id % 1000 = 7 GROUP BY ALL")
def output_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs that differ in every thousandth row; each difference shows on both sides."""
    a = history(spark, sf_dir)
    b = history(spark, sf_dir, vectorised=False).withColumn("dim1", F.when(F.col("dim0") % 1000 == 7, F.col("dim1") + 1).otherwise(F.col("dim1")))
    found = rows.differences(a, b)
    return found.groupBy(F.when(F.col("surplus") > 0, "left").otherwise("right").alias("side"), "block").agg(F.count("*").alias("n"))


@query("SELECT event_id, event_id || chr(9) || printf('%.6f', value) || chr(9) || lower(hex(encode(event_type))) AS line FROM events")
def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated lines with numbers of six digits and binary as hexadecimal."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.encode("event_type", "UTF-8").alias("raw"))
    return e.select("event_id", F.concat_ws("\t", F.col("event_id").cast("string"), text.exported([("value", False), ("raw", True)], 6)).alias("line"))


@query("SELECT o_orderkey, 3735928559 + o_orderkey * 0 AS a, true AS ok, 20 + strlen(o_orderstatus || o_orderpriority) AS size, o_orderstatus || o_orderpriority AS payload FROM orders")
def frame_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Framing, checksum and unframing in JVM code; a group beyond 31 bits stays what it is."""
    orders = table(spark, sf_dir, "orders")
    block = unframe(frame(F.lit(3735928559), F.encode(F.concat("o_orderstatus", "o_orderpriority"), "UTF-8")))
    return orders.select("o_orderkey", block.alias("b")).select("o_orderkey", F.col("b.group").alias("a"), F.col("b.ok").alias("ok"), F.col("b.size").alias("size"), F.decode("b.payload", "UTF-8").alias("payload"))


@query(_TYPES + ' SELECT CAST(g AS VARCHAR) AS source, g AS "group", count(*) AS blocks, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(min(0) AS BIGINT) AS first FROM b GROUP BY g')
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's bytes with garbage between blocks, in chunks of 1,000 cut anywhere, parsed back."""
    dirty = F.concat(frame(F.col("group"), F.col("payload")), F.unhex(F.lit("51EDA7A051ED00")))
    files = _type_blocks(spark, sf_dir).groupBy(F.col("group").cast("string").alias("source")).agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", dirty.alias("d")))), lambda x: F.hex(x["d"])), "")).alias("content"))
    chunks = files.select("source", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("content") / 1000).cast("int"))).alias("seq"), "content").select("source", "seq", F.substr("content", F.col("seq") * 1000 + 1, F.lit(1000)).alias("data"))
    return parse_chunks(chunks).groupBy("source", "group").agg(F.count("*").alias("blocks"), F.sum(F.octet_length("payload")).cast("long").alias("bytes"), F.min("offset").alias("first"))


def written(blocks: Iterable[tuple[int, bytes]]) -> bytes:
    """A recording's bytes, for tests and examples."""
    return b"".join(encode(g, p) for g, p in blocks)
