import io
import random
import zlib

import pytest

from blockstrata.errors import InvalidBlock
from blockstrata.sources import framing as f
from blockstrata.sources.writer import FLUSH, FileStream, Writer, index_bytes


def _file(blocks, **options):
    out = io.BytesIO()
    with Writer(out.write, **options) as w:
        for group, payload in blocks:
            w.write_block(group, payload)
    return out


def test_block_layout():
    data = f.encode(7, b"abc")
    assert data[:12] == bytes([0, 0, 0, 23, 0, 0, 0, 7]) + f.SYNC and len(data) == 23
    assert int.from_bytes(data[15:19], "big") == zlib.crc32(data[:15]) and data[19:] == bytes([0, 0, 0, 23])
    assert zlib.crc32(b"hello") == 0x3610A686
    b = f.decode(data)
    assert (b.group, b.payload, b.crc_ok, b.size) == (7, b"abc", True, 23)


def test_damage_is_told():
    data = bytearray(f.encode(7, b"abc"))
    data[13] ^= 1
    assert not f.decode(bytes(data)).crc_ok
    with pytest.raises(InvalidBlock):
        f.decode(bytes(data), verify=True)
    assert f.decode(f.encode(1, b"x", checksum=False), verify=True).crc_ok  # no checksum is a right one
    for at in (0, 8, 22):
        broken = bytearray(f.encode(7, b"abc"))
        broken[at] ^= 0x40
        with pytest.raises(InvalidBlock):
            f.decode(bytes(broken))
    with pytest.raises(InvalidBlock):
        f.decode(b"short")


def test_legacy_framing():
    b = f.decode_legacy(f.encode(3, b"payload", legacy=True))
    assert (b.group, b.payload, b.crc_ok) == (3, b"payload", True)
    with pytest.raises(InvalidBlock):
        f.decode(f.encode(3, b"payload", legacy=True))
    with pytest.raises(InvalidBlock):
        f.decode_legacy(f.encode(3, b"payload"))


@pytest.mark.parametrize("index", [True, False])
def test_index_forward_and_backward(index):
    blocks = [(2 + i % 3, bytes([i % 256]) * (i % 50)) for i in range(300)]
    file = f.BlockFile(_file(blocks, index=index))
    forward, backward = list(file.forward()), file.backward()
    assert forward == backward == file.index() and len(forward) == 300 + index
    assert [(e.group, file.read_at(e.offset).payload) for e in forward if e.group != 1] == blocks
    assert file.is_recording() and not f.BlockFile(io.BytesIO(b"no")).is_recording()


def test_unindexed_tail_and_garbage():
    out = _file([(2, b"a"), (2, b"b")])
    out.seek(0, 2)
    tail = f.encode(3, b"c") + f.encode(3, b"d")
    out.write(tail)
    file = f.BlockFile(out)
    assert [e.group for e in file.unindexed()] == [3, 3] and len(file.index()) == 5
    out.seek(0, 2)
    out.write(b"garbage" + f.SYNC + b"more")
    file = f.BlockFile(out)
    assert file.last_block().group == 3 and file.last_block().offset == file.size - len(b"garbage....more") - 21
    assert len(file.index()) == 5  # backwards fails at once, forwards finds all
    assert file.last_block(8) is None
    plain = f.BlockFile(io.BytesIO(f.encode(4, b"x") * 3))
    assert len(plain.unindexed()) == 3


def test_index_must_rise():
    payload = f.index_payload([(0, 2), (40, 3)])
    assert f.read_index(payload, 90) == [f.Entry(0, 40, 2), f.Entry(40, 50, 3)]
    for bad, end in ((f.index_payload([(40, 2), (0, 3)]), 90), (payload, 45), (payload + b"x", 90)):
        with pytest.raises(InvalidBlock):
            f.read_index(bad, end)


def test_sizes_are_predicted():
    for blocks, index in ((0, True), (1, True), (40, False), (12_000, True)):
        out = io.BytesIO()
        writer = Writer(out.write, index)
        writer.xml_header()
        expected = writer.total_size(blocks * 3, blocks)
        writer.flush_xml()
        for _ in range(blocks):
            writer.write_block(5, b"abc")
        writer.close()
        assert len(out.getvalue()) == expected == writer.offset
    assert index_bytes(FLUSH // 12 + 2) == 12 * (FLUSH // 12 + 2) + 40


def test_ids_and_xml_flush():
    out = io.BytesIO()
    writer = Writer(out.write)
    assert [writer.next_id(k) for k in ("group", "group", "decoder", "test", "ch", "ch")] == [2, 3, 2, 0, 0, 1]
    writer.xml_string("x" * FLUSH)
    assert not out.getvalue()
    writer.xml_string("y")
    assert len(out.getvalue()) == FLUSH + 21


@pytest.mark.parametrize("legacy", [False, True])
def test_stream_is_cut_anywhere(legacy, tmp_path):
    draw = random.Random(4)
    blocks = [(draw.randrange(2, 5), draw.randbytes(draw.randrange(90))) for _ in range(200)]
    data = b"".join(f.encode(g, p, legacy=legacy) + (draw.choice([b"", b"junk", f.SYNC, b"\0" * 9])) for g, p in blocks)
    parser, found, at = f.StreamParser(legacy), [], 0
    while at < len(data):
        n = draw.randrange(1, 60)
        found += parser.feed(data[at : at + n])
        at += n
    assert [(b.group, b.payload) for b in found] == blocks
    if not legacy:
        assert all(f.decode(data, b.offset).payload == b.payload for b in found)
        again, _ = f.resync(data, 0, len(data))
        assert [(b.group, b.payload) for b in again] == blocks


def test_file_stream(tmp_path):
    seen = []
    stream = FileStream(str(tmp_path / "s"), on_xml=seen.append)
    data = f.encode(0, b"<sie>") + f.encode(5, b"one") + f.encode(5, b"two") + f.encode(5, b"")
    assert sum(stream.add(data[i : i + 7]) for i in range(0, len(data), 7)) == len(data)
    assert seen == ["<sie>"] and stream.num_groups() == 2 and stream.highest_group() == 5
    assert stream.read_block(5, 1) == b"two" and stream.is_group_closed(5) and not stream.is_group_closed(0)
    stream.close()
    with open(tmp_path / "s", "rb") as file:
        assert len(f.BlockFile(file).index()) == 4
