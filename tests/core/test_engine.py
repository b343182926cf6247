import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockstrata import api
from blockstrata.errors import FileSeekError, InvalidBlock, InvalidData, status_message
from blockstrata.functions import expr, text
from blockstrata.operators import crush, groups, recover, rows, sift
from blockstrata.operators.histogram import histogram
from blockstrata.plans.kernels import evaluate
from blockstrata.plans.program import compile_decoder, expression
from blockstrata.sources import datasource
from blockstrata.sources.decoding import frame, unframe
from blockstrata.sources.framing import encode
from blockstrata.sources.recording import Recording
from blockstrata.sources.writer import FileStream, Writer
from blockstrata.sources.xml import parse
from blockstrata.streaming import ingest

XML = """
<decoder id="2"><read var="start" bits="64" type="uint" endian="little"/><loop var="n"><read var="v1" bits="32" type="float" endian="little"/><set var="v0" value="{$start + $n}"/><sample/></loop></decoder>
<decoder id="3"><loop><read var="n" bits="16" type="uint" endian="little"/><read var="v0" bits="32" type="uint" endian="little"/><read var="v1" octets="{$n - 6}"/><sample/></loop></decoder>
<decoder id="4"><loop><read var="v0" bits="32" type="uint" endian="little"/><read var="v1" bits="32" type="float" endian="little"/><read var="v2" bits="32" type="float" endian="little"/><sample/></loop></decoder>
<ch id="0" private="1"><dim index="0"><xform scale="0.001" offset="0"/><data decoder="2" v="0"/></dim><dim index="1"><data decoder="2" v="1"/></dim></ch>
<test id="0" name="run"><tag id="photo" group="9" format="image/x"/><ch id="1" base="0" group="4" name="history"/><ch id="2" group="5" name="messages"><dim index="0"><data decoder="3" v="0"/></dim><dim index="1"><data decoder="3" v="1"/></dim><dim index="2"><data decoder="3" v="7"/></dim></ch>
<ch id="3" group="6" name="counts"><dim index="0"><data decoder="4" v="0"/></dim><dim index="1"><data decoder="4" v="1"/></dim><dim index="2"><data decoder="4" v="2"/></dim></ch><ch id="4" name="abstract"/></test>
"""
N, ROWS = 82, 320


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    name = str(tmp_path_factory.mktemp("rec") / "a.rec")
    with open(name, "wb") as f, Writer(f.write) as w:
        w.xml_header()
        w.xml_string(XML)
        w.flush_xml()
        for b in range(N):
            w.write_block(4, struct.pack("<Q", b * ROWS) + np.sin(np.arange(b * ROWS, (b + 1) * ROWS) / 50).astype("<f4").tobytes())
            if b % 10 == 0:
                body = bytes(range(b % 7))
                w.write_block(5, struct.pack("<HI", len(body) + 6, b) + body)
        w.write_block(6, struct.pack("<IffIffIff", 5, 0, 1, 7, 2, 3, 9, 0, 1))
        w.write_block(9, b"pic")
        w.write_block(9, b"ture")
    return name


def test_open_and_look(spark, path):
    file = api.open_file(spark, path)
    assert [c.name for c in file.channels()] == ["history", "messages", "counts", "abstract"] and file.tests()[0].name == "run"
    assert file.table("tests").count() == 1 and file.table("channels").count() == 4 and file.table("dims").count() == 8
    decoders = file.table("decoders").collect()
    assert {d.decoder_id for d in decoders} == {0, 1, 2, 3, 4} and all(d.error is None for d in decoders)
    tags = groups.tag_values(file.table("tags"), file.table("blocks")).where("key = 'photo'").collect()
    assert bytes(tags[0].value_bin) == b"picture" and tags[0].format == "image/x"
    assert groups.channels_with_tests(file.table("channels"), file.table("tests")).count() == 4
    assert "channel 2 messages" in file.dump(2) and "has no data" in file.dump(2)
    with pytest.raises(InvalidData):
        file.channel(77)
    with Recording(path) as r:
        assert r.num_blocks(4) == N and r.num_bytes(9) == 7 and r.tag_value(9) == b"picture" and r.highest_group() == 9 and r.block(9, 1).payload == b"ture" and r.data_groups() == [4, 5, 6, 9]


def test_rows_and_bounds(spark, path):
    file = api.open_file(spark, path)
    out = file.read(1)
    assert out.columns == ["block", "scan", "dim0", "dim1"] and out.count() == N * ROWS
    raw = file.read(1, transforms=False)
    assert rows.equal(file.transform(1, raw), out)
    values = {(r.block, r.scan): (r.dim0, r.dim1) for r in out.collect()}
    assert values[10, 5] == (3205 * 0.001 + 0.0, float(np.float32(np.sin(3205 / 50))))
    for x in [0.0, 3.2, 3.2005, 1.999, 26.239, 26.2391, -1.0, 13.125, 13.125 + 1e-6, 13.125 - 1e-6]:
        at = sorted(k for k, v in values.items() if v[0] >= x)
        to = sorted(k for k, v in values.items() if v[0] <= x)
        assert file.lower_bound(1, 0, x) == (at[0] if at else None) and file.upper_bound(1, 0, x) == (to[-1] if to else None)
    assert file.read(1, scan_limit=3).count() == 3 * N and rows.limit_total(out, 400).count() == 400
    assert rows.value_range(out, "dim0", 1, 318, 10) == [638 * 0.001, 639 * 0.001] and rows.value_range(out, "dim0", 1, 400, 3) == []
    assert rows.cell(out, "dim0", 0, 1) == 0.001 and rows.cell(out, "dim9", 0, 1) is None and rows.cell(out, "dim0", 99, 1) is None
    assert rows.num_blocks(out) == N and rows.seek(out, 80).count() == 2 * ROWS
    messages = file.read(2)
    assert [f.dataType.simpleString() for f in messages.schema][2:] == ["double", "binary", "double"]
    assert {r.dim0: bytes(r.dim1) for r in messages.collect()}[30.0] == bytes(range(2)) and messages.where("dim2 IS NOT NULL").count() == 0
    with pytest.raises(InvalidData):
        rows.lower_bound(messages, "dim1", 1)
    with pytest.raises(InvalidData):
        crush.crush(messages, 4)


def test_reader_reads_what_it_must(spark, path):
    blocks = datasource.read(spark, path, partition_bytes=20_000)
    assert blocks.rdd.getNumPartitions() > 4 and blocks.count() == N + 9 + 1 + 2 + 1 + 1
    assert datasource.read(spark, path, group=9).count() == 2
    narrow = datasource.read(spark, path, partition_bytes=20_000, group=9)
    assert [r.block for r in narrow.orderBy("offset").collect()] == [0, 1] and narrow.rdd.getNumPartitions() == 1
    assert blocks.where("group = 9").count() == 2 and blocks.where("group = 4").count() == N and blocks.count() > N  # a frame used again is whole
    some = datasource.read(spark, path, channel=1, from_block=80, partition_bytes=1000)
    assert some.rdd.getNumPartitions() == 2 and sorted({r.block for r in some.collect()}) == [80, 81]
    assert datasource.read(spark, path, channel=1, from_block=3, to_block=3).count() == ROWS
    assert datasource.read(spark, path, table="index", group=4).agg(F.sum("payload_size")).first()[0] == N * (8 + 4 * ROWS)
    assert datasource.read(spark, path, channel=1, dims="1").columns == ["block", "scan", "dim1"]
    assert api.open_file(spark, path).decode(1, blocks).count() == N * ROWS


@pytest.mark.parametrize("size", [37, 1000, 50_000])
def test_splits_own_what_begins_in_them(spark, path, tmp_path, size):
    whole = datasource.read(spark, path).select("offset", "group", "payload")
    split = datasource.read(spark, path, split="true", partition_bytes=max(size, 20_000)).select("offset", "group", "payload")
    assert rows.equal(whole, split)
    with open(path, "rb") as f:
        data = f.read(30_000)
    dirty = tmp_path / "dirty"
    dirty.write_bytes(b"junk" + data + b"\x51\xed\xa7")
    with open(dirty, "rb") as f:
        file = datasource.BlockFile(f)
        ranges = [b.offset for low in range(0, file.size, size) for b in datasource.blocks_in(file, low, min(file.size, low + size), 64)]
        assert ranges == [b.offset for b in datasource.blocks_in(file, 0, file.size)] and len(ranges) > 10


def test_bounds_read_few_blocks(path, monkeypatch):
    with Recording(path) as r:
        read, channel = [], r.catalog.channel(1)
        payload = r.payload
        monkeypatch.setattr(r, "payload", lambda e, *a: read.append(e.offset) or payload(e, *a))
        for upper in (False, True):
            read.clear()
            assert r.bound(channel, 0, 3205.5, upper) == (10, 5 if upper else 6)
            assert len(read) <= 9  # of 82
        with pytest.raises(InvalidData):
            r.bound(channel, 7, 1.0, False)


def test_one_block_is_one(spark):
    one = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "block long, scan long, dim0 double")
    assert rows.num_blocks(one) == 1 and rows.num_blocks(one.limit(0)) == 0
    many = spark.range(50_000).selectExpr("id * 7 AS block", "0L AS scan", "double(id) AS dim0")
    assert rows.ordinal(many).where("row <> dim0").count() == 0  # over several stretches of blocks


def test_a_stream_keeps_the_bytes_that_came(tmp_path):
    sent = encode(4, b"one", crc=99) + encode(4, b"two") + encode(4, b"three", checksum=False)
    stream = FileStream(str(tmp_path / "s"))
    for i in range(0, len(sent), 7):
        stream.add(sent[i : i + 7])
    stream.close()
    assert (tmp_path / "s").read_bytes() == sent


def test_overwriting_leaves_what_others_put_there(spark, tmp_path):
    folder = tmp_path / "f"
    folder.mkdir()
    (folder / "notes.txt").write_text("mine")
    (folder / "sub").mkdir()
    (folder / "sub" / "part-00000-x.rec").write_bytes(encode(3, b"theirs"))
    datasource.register(spark)
    for k in range(2):
        df = spark.createDataFrame([(5, f"block {k}".encode())], "group long, payload binary").coalesce(1)
        df.write.format("recording").option("path", str(folder)).mode("overwrite").save()
    assert (folder / "notes.txt").read_text() == "mine" and (folder / "sub" / "part-00000-x.rec").exists()
    (only,) = folder.glob("part-*.rec")
    with open(only, "rb") as f:
        assert datasource.BlockFile(f).read_at(0).payload == b"block 1"


def test_tail_passes_damage_and_waits_for_the_rest(tmp_path):
    good, more = encode(2, b"a" * 30), encode(2, b"b" * 40)
    broken = bytearray(encode(2, b"c" * 20))
    broken[0:4] = b"\x00\x00\x00\x30"  # a wrong size
    name, tail = str(tmp_path / "g.rec"), datasource.Tail(str(tmp_path))
    seen, at = [], tail.initialOffset()
    for piece in (good, bytes(broken) + more[:10], more[10:], good + good[:5], good[5:]):
        with open(name, "ab") as f:
            f.write(piece)
        end = tail.latestOffset()
        seen.append([len(r[7]) for p in tail.partitions(at, end) for r in tail.read(p)])
        at = end
    assert seen == [[30], [], [40], [30], [30]]


def test_gluing_over_files(spark, tmp_path):
    draw = np.random.default_rng(3)
    blocks = [encode(3, draw.integers(0, 256, n, dtype=np.uint8).tobytes()) for n in (30, 41, 52, 63, 74)]
    torn = blocks[0] + blocks[1][:20] + b"junk" + blocks[2] + blocks[1][20:] + blocks[3][:17] + blocks[4]
    (tmp_path / "a.rec").write_bytes(blocks[0] + blocks[1][:25] + b"??" + blocks[1][25:] + blocks[2])
    (tmp_path / "b.rec").write_bytes(torn)
    (tmp_path / "c.rec").write_bytes(blocks[4] + blocks[0][:15] + b"x" + blocks[2] + b"yy" + blocks[3] + b"z" + blocks[0][15:] + blocks[1])
    for size in (1000, 50):
        got = sorted((os.path.basename(r.file), r.left, r.right, r.size, r.split) for r in recover.glued(spark, str(tmp_path), partition_bytes=size).collect())
        assert got[0] == ("a.rec", 0, 1, 61, 25)
        want = [(g.left, g.right, g.size, g.split) for g in recover.recover((tmp_path / "c.rec").read_bytes()).glued]
        assert [g[1:] for g in got if g[0] == "c.rec"] == want and len(want) == 1


def test_export(spark, path, tmp_path):
    api.open_file(spark, path).export(2, str(tmp_path / "t"), 3)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect())[2] == "20.000\t000102030405\t"


def test_histogram(spark, path):
    h = api.open_file(spark, path).histogram(3)
    assert h.sizes == [2] and h.value(0) == 9.0 and h.value(1) == 7.0 and h.value(5) == 0.0 and h.total() == 2  # the later row of a bin counts
    assert h.find(0, 2.0, 3.0) == 1 and h.find(0, 2.0, 4.0) is None and [(r.lower, r.upper) for r in h.bounds(0).collect()] == [(0.0, 1.0), (2.0, 3.0)]
    data = [(0, s, float(v), lo, lo + 1.0, hi, hi + 1.0) for s, (v, lo, hi) in enumerate([(10, 0.0, 5.0), (0, 1.0, 5.0), (4, 2.0, 7.0), (6, 2.0, 7.0)])]
    two = histogram(spark.createDataFrame(data, "block long, scan long, dim0 double, dim1 double, dim2 double, dim3 double, dim4 double"))
    assert two.sizes == [3, 2] and [r.value for r in two.dense().orderBy("flat").collect()] == [10, 0, 0, 0, 0, 6] and [r.flat for r in two.nonzero().collect()] == [0, 5]
    assert two.unflat(5) == [2, 1] and two.next_nonzero() == (0, 10.0) and two.next_nonzero(1) == (5, 6.0) and two.next_nonzero(6) is None
    assert two.with_bin(3.0, 1, 1).value(1, 1) == 3.0 and two.with_bin(3.0, 9, 9) is two and two.with_bin_at(8.0, (2.0, 3.0), (7.0, 8.0)).value(2, 1) == 8.0
    with pytest.raises(InvalidData):
        two.with_bin_at(1.0, (9.0, 9.0), (7.0, 8.0))
    with pytest.raises(InvalidData):
        histogram(spark.createDataFrame([(0, 0, 1.0, 2.0)], "block long, scan long, dim0 double, dim1 double"))


def _crushed(values, ideal):
    """Buckets that double whenever they are all full."""
    width, out = 1, []
    for v in values:
        if out and len(out[-1]) < width:
            out[-1].append(v)
        else:
            out.append([v])
        if len(out) == 2 * ideal and len(out[-1]) == width:
            out, width = [a + b for a, b in zip(out[::2], out[1::2], strict=True)], width * 2
    return [(min(b), max(b)) for b in out]


@pytest.mark.parametrize(("n", "ideal"), [(1, 1), (2, 1), (7, 2), (8, 2), (100, 7), (333, 10)])
def test_crush(spark, n, ideal):
    values = [float((i * 37) % 101) for i in range(n)]
    df = spark.createDataFrame([(i // 16, i % 16, v) for i, v in enumerate(values)], "block long, scan long, dim0 double")
    got = [(r.out0, r.out1) for r in crush.crush(df, ideal).orderBy("bucket").collect()]
    assert got == _crushed(values, ideal)


def test_crush_edges(spark):
    df = spark.createDataFrame([(0, 0, float("nan")), (0, 1, 2.0), (0, 2, 1.0)], "block long, scan long, dim0 double")
    assert [(r.out0, r.out1, r.n) for r in crush.crush(df, 1).collect()] == [(1.0, 2.0, 3)] or crush.bucket_width(3, 1) == 2
    assert crush.crush(df.limit(0), 5).collect() == []
    with pytest.raises(ValueError):
        crush.crush(df, 0)


def test_sift(spark, path, tmp_path):
    out = str(tmp_path / "b.rec")
    size = api.sift(path, out, [(1, 42, 63), (2, 0, None), (1, 50, 70)])
    assert os.path.getsize(out) == size
    with Recording(path) as r, open(os.devnull, "wb") as f:
        w = Writer(f.write)
        w.xml_header()
        s = sift.Sifter(w)
        s.add(r, 1, 42, 63)
        s.add(r, 2)
        s.add(r, 1, 50, 70)
        expected = s.total_size()
        s.finish()
        w.close()
        assert expected == w.offset == size and s.find_id("group", path, 4) == 2 and s.find_id("group", path, 99) is None and s.total_entries() > 4
    file, old = api.open_file(spark, out), api.open_file(spark, path)
    assert sorted(c.name for c in file.channels()) == ["history", "messages"]
    history = next(c for c in file.channels() if c.name == "history")
    a = file.read(history.id).withColumn("block", F.col("block") + 42)
    assert rows.equal(a, old.read(1).where("block >= 42 AND block < 70"))
    messages = next(c for c in file.channels() if c.name == "messages")
    assert rows.equal(file.read(messages.id), old.read(2))


def test_sift_by_signature():
    loop = '<decoder id="{}"><loop><read var="{}" bits="{}" type="uint" endian="big"/><sample/></loop></decoder>'
    a, same, other = (compile_decoder(parse(loop.format(*x))).signature() for x in ((1, "v0", 8), (7, "v0", 8), (1, "v0", 16)))
    s = sift.Sifter(Writer(lambda data: None))
    assert s.find_id_by_signature("decoder", a) is None
    first = s.map_id_by_signature("decoder", a)
    assert s.map_id_by_signature("decoder", same) == s.find_id_by_signature("decoder", a) == first
    assert s.map_id_by_signature("decoder", other) == first + 1 and s.map_id("decoder", "a.rec", 1) == first + 2
    assert s.find_id_by_signature("test", a) is None and s.total_entries() == 3


def test_recover(tmp_path):
    blocks = [encode(2, bytes([i]) * (30 + i)) for i in range(12)]
    data = b"".join(blocks)
    assert len(recover.recover(data).parts) == 1 and recover.recover(data).glued == []
    broken = bytearray(data)
    broken[len(blocks[0]) + 14] ^= 1
    found = recover.recover(bytes(broken)).parts
    assert [len(p.blocks) for p in found] == [1, 10] and found[1].offset == len(blocks[0] + blocks[1])
    torn = b"".join(blocks[:4]) + blocks[4][:25] + b"garbage" * 9 + blocks[4][25:] + b"".join(blocks[5:])
    got = recover.recover(torn)
    assert [len(p.blocks) for p in got.parts] == [4, 7] and [(g.left, g.right, g.size, g.split) for g in got.glued] == [(0, 1, len(blocks[4]), 25)]
    assert json.loads(got.to_json())["glued"][0]["split"] == 25
    assert recover.try_glue(blocks[0][:10], blocks[0][10:], 8) is None
    assert recover.recover(torn, mod=1 << 20).glued == []
    zero = encode(2, b"x", checksum=False)
    assert recover.parts(zero) == [] and len(recover.parts(zero, accept_zero=True)) == 1
    p = tmp_path / "t"
    p.write_bytes(torn)
    assert len(api.recover(str(p)).parts) == 2


def test_recover_tables(spark):
    data = b"".join(encode(2, bytes([i]) * 9) for i in range(5))
    df = spark.createDataFrame([("a", bytearray(data)), ("b", bytearray(b"??" + data)), ("c", bytearray(b"")), ("d", None)], "file string, content binary")
    good = recover.good_blocks(df)
    assert {r.file: r.blocks for r in recover.part_table(good).collect()} == {"a": 5, "b": 5}
    assert json.loads(recover.part_json(good).where("file = 'a'").first().json)["parts"][0]["blocks"][1]["size"] == 29


def test_write_and_read_back(spark, tmp_path):
    datasource.register(spark)
    df = spark.range(50).select((F.col("id") % 3 + 2).alias("group"), F.encode(F.col("id").cast("string"), "UTF-8").alias("payload"))
    out = str(tmp_path / "out")
    for mode in ("append", "overwrite"):
        df.repartition(3).write.format("recording").option("xml", "<tag id='t'>v</tag>").mode(mode).save(out)
        back = datasource.read(spark, out).where("group >= 2")
        assert sorted(int(bytes(r.payload)) for r in back.collect()) == list(range(50))
    assert {r.key for r in datasource.read(spark, out, table="tags").collect()} >= {"t"}


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    data = b"".join(encode(2 + i % 2, bytes([i]) * i) for i in range(20))
    (folder / "a").write_bytes(data[:300])
    seen = []
    q = ingest.tail(spark, str(folder)).writeStream.foreachBatch(lambda df, _: seen.extend((r.group, bytes(r.payload)) for r in df.orderBy("offset").collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert 0 < len(seen) < 20
        (folder / "a").write_bytes(data)
        q.processAllAvailable()
    finally:
        q.stop()
    assert seen == [(2 + i % 2, bytes([i]) * i) for i in range(20)]


def test_stateful_chunks(spark, tmp_path):
    data = b"".join(encode(3, bytes([i]) * 40) for i in range(30)) + encode(3, b"")
    source = str(tmp_path / "chunks")
    for batch in range(3):
        part = [(f"s{s}", i, bytearray(data[i * 100 : (i + 1) * 100])) for s in range(2) for i in range(batch * 7, (batch + 1) * 7)]
        spark.createDataFrame(part, "source string, seq int, data binary").write.mode("append").parquet(source)
    stream = spark.readStream.schema("source string, seq int, data binary").option("maxFilesPerTrigger", 100).parquet(source)
    q = ingest.blocks_of(stream).writeStream.format("memory").queryName("parsed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    counts = {r.source: (r.blocks, r.closed) for r in ingest.group_counts(spark.table("parsed")).collect()}
    assert counts == {"s0": (31, True), "s1": (31, True)}


def test_follower_keeps_the_catalog_up(spark):
    seen = []
    follow = ingest.Follower(lambda df, catalog, epoch: seen.append((epoch, df.count(), [c.id for c in catalog.channels])))
    part = lambda text, offset: spark.createDataFrame([(offset, 0, bytearray(text.encode()))], "offset long, group long, payload binary")
    follow(part("<sie><test id='0'><ch id='1'/></te", 0), 0)
    follow(part("st><ch test='0' id='2'/>", 50), 1)
    assert seen == [(0, 1, []), (1, 1, [1, 2])]


def test_expressions_as_columns_equal_the_program(spark):
    values = [0.0, 1.0, -1.0, 2.5, 7.0, 63.0, 64.0, 1e10, 2.0**53, 2.0**63, 2.0**64, 1e300, -1e300, float("inf"), float("-inf"), float("nan")]
    df = spark.createDataFrame([(a, b) for a in values for b in values], "a double, b double")
    texts = ["{$a + $b}", "{$a / $b}", "{$a & $b}", "{$a | $b}", "{$a << $b}", "{$a >> $b}", "{!$a}", "{$a < $b}", "{$a <= $b}", "{$a >= $b}", "{$a == $b}", "{$a != $b}", "{$a && $b}", "{$a || $b}", "{-($a)}"]
    out = df.select("a", "b", *(expr.column(t, {"a": F.col("a"), "b": F.col("b")}).alias(f"c{i}") for i, t in enumerate(texts))).collect()
    for i, t in enumerate(texts):
        want = evaluate(expression(t), {"a": np.array([r.a for r in out]), "b": np.array([r.b for r in out])})
        with np.errstate(all="ignore"):
            np.testing.assert_array_equal(np.array([r[f"c{i}"] for r in out]), want, err_msg=t)


def test_framing_columns(spark):
    df = spark.createDataFrame([(2, bytearray(b"abc")), (4294967295, bytearray(b""))], "g long, p binary").select("g", "p", frame(F.col("g"), F.col("p")).alias("b"))
    for r in df.select("*", unframe(F.col("b")).alias("u")).collect():
        assert bytes(r.b) == encode(r.g, bytes(r.p)) and (r.u.group, bytes(r.u.payload), r.u.ok) == (r.g, bytes(r.p), True)
    assert df.select(unframe(F.unhex(F.lit("00"))).alias("u")).first().u is None


def test_text_helpers(spark):
    df = spark.createDataFrame([(" a=1 & b = two&c&a=3", "<tag x='q'>", " -1.5e2x", " \t1\n", "AbC")], "r string, t string, n string, s string, c string")
    found = text.pairs(F.col("r"))
    r = df.select(
        found.alias("rel"), text.relation_value(found, "a").alias("a"), text.relation_value(found, "z").alias("z"), text.relation_int(found, "a").alias("i"), text.relation_float(found, "b").alias("f"),
        text.relation_set(found, "b", F.lit("9")).alias("set"), text.relation_set(found, "n", F.lit("9")).alias("new"), text.relation_delete(found, "a").alias("gone"), text.relation_merge(found, text.pairs(F.lit("a=7&y=8"))).alias("merged"),
        text.tag_name(F.col("t")).alias("tag"), text.quoted(F.col("t")).alias("q"), text.leading_number(F.col("n")).alias("lead"), text.strip(F.col("s")).alias("bare"), text.same_text(F.col("c"), F.lit("aBc")).alias("same"), text.int_text(F.lit(5.0)).alias("five"), text.index_of(F.col("c"), "C").alias("at"), text.index_of(F.col("c"), "x").alias("no"),
        text.checksum_ok(F.encode(F.lit("hello"), "UTF-8"), F.lit(0x3610A686)).alias("ok"), text.checksum_ok(F.encode(F.lit("hello"), "UTF-8"), F.lit(0)).alias("none"),
    ).first()
    plain = lambda x: [(p["name"], p["value"]) for p in x]
    assert plain(r.rel) == [("a", "1"), ("b", "two"), ("c", ""), ("a", "3")] and (r.a, r.z, r.i, r.f) == ("1", None, 1, None)
    assert plain(r.set)[1] == ("b", "9") and plain(r.new)[-1] == ("n", "9") and plain(r.gone) == [("b", "two"), ("c", "")] and plain(r.merged)[-1] == ("y", "8")
    assert (r.tag, r.q, r.lead, r.bare, r.same, r.five, r.at, r.no, r.ok, r["none"]) == ("tag", "q", -150.0, "1", True, "5", 2, None, True, True)


def test_errors(tmp_path):
    assert status_message(0) == "Ok" and status_message(InvalidBlock.status) == "InvalidBlock" and status_message(99) == "Unknown"
    assert rows.position(3, 10, by=4) == 7 and rows.position(3, 10, to=10) == 10
    with pytest.raises(FileSeekError):
        rows.position(3, 10, by=-4)
    (tmp_path / "x").write_bytes(b"not a recording at all")
    with pytest.raises(InvalidBlock):
        Recording(str(tmp_path / "x"))


def test_lookup_transforms(spark):
    df = spark.createDataFrame([(-3.0,), (0.9,), (1.0,), (2.0,), (99.0,), (float("nan"),)], "dim0 double")
    table = spark.createDataFrame([(0, 10.0), (1, 20.0)], "idx long, value double")
    small = [r.x for r in df.select(rows.lookup(F.col("dim0"), [10.0, 20.0]).alias("x")).collect()]
    joined = sorted(r.dim0 for r in rows.lookup_table(df, "dim0", table).collect())
    assert small[:5] == [10.0, 10.0, 20.0, 2.0, 99.0] and joined[:5] == [2.0, 10.0, 10.0, 10.0, 20.0]
