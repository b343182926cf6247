import hashlib
import random

import numpy as np
import pytest

from blockstrata.llm import exact_dedup, induced, queries


def _brute(rows, length=50):
    first = {}
    data = [(float("inf") if d is None else d, (t or "").encode()) for d, t in rows]
    for d, b in data:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0]) if len(b) else 0
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out)


def _rows(out):
    return sorted((float("inf") if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out)


def test_odd_and_empty(spark, odd, none, as_dir):
    out = queries.op5_exact_dedup(spark, as_dir(documents=odd)).collect()
    assert _rows(out) == _brute([(r.doc_id, r.text) for r in odd.collect()])
    assert queries.op5_exact_dedup(spark, as_dir(documents=none)).collect() == []


@pytest.mark.parametrize("length", [50, 33])
def test_by_brute_force(spark, length, monkeypatch):
    monkeypatch.setattr(exact_dedup, "_STRIP", 1 << 9)  # so that texts are cut into strips
    draw = random.Random(length)
    text = lambda n: "".join(draw.choice("abcdé漢 \n") for _ in range(n))
    shared = [text(draw.choice([20, 49, 50, 51, 90, 400])) for _ in range(12)] + ["a" * 300, "ab" * 80, "a" * 49]
    rows = []
    for i in range(160):
        rows.append((draw.randrange(150) if i % 5 else None, "".join(draw.choice([draw.choice(shared), text(draw.choice([0, 3, 30]))]) for _ in range(draw.randrange(6)))))
    rows += [(500, rows[3][1]), (501, "x" * 2000), (502, "x" * 1999 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert _rows(exact_dedup.cut(df, length).collect()) == _brute(rows, length)


def _segments(parts):
    return np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.uint16) + 1, 0) for p in parts]).astype(np.uint16)


@pytest.mark.parametrize("alphabet", [b"ab", b"abc", bytes([0, 255, 254]), b"a", bytes(range(256))])
def test_suffix_order_and_common_prefixes(alphabet):
    draw = random.Random(len(alphabet))
    for memory in (200, 1 << 20):  # the first spills to disk
        for _ in range(25):
            text = _segments([bytes(draw.choice(alphabet) for _ in range(draw.choice([1, 3, 10, 60]))) for _ in range(draw.choice([1, 2, 5, 20]))])
            order, common = induced.suffixes(text, memory)
            ends = np.flatnonzero(text == 0)
            until = ends[np.searchsorted(ends, np.arange(len(text)))]
            all_of = [tuple(text[p : until[p]].tolist()) for p in order]
            assert sorted(order.tolist()) == list(range(len(text)))
            for i in range(1, len(all_of)):
                a, b = all_of[i - 1], all_of[i]
                assert a <= b
                n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                assert common[i] == min(n, induced.LONGEST)


def test_a_hot_line_in_differing_context_is_split(spark):
    draw = random.Random(1)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    line, contexts = "a line that nearly every document of the table has 1", [(text(40), text(40)) for _ in range(1500)]
    rows = [(i, a + line + b) for i, (a, b) in enumerate(contexts)] + [(2000 + i, a[20:] + line + b[:20]) for i, (a, b) in enumerate(contexts[:100])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    table = exact_dedup.Staged(exact_dedup.blocks(df, block_bytes=1 << 15), "blocks").read()
    length, shards, most = 50, 40, 200
    bits = exact_dedup._elsewhere(exact_dedup._anchors(table.drop("rest"), length, shards), shards, most)
    sent = exact_dedup._sent(table.drop("rest").join(exact_dedup._collected(bits, "bits"), "block", "left").select("block", "ids", "offs", "raw", "bits"), length, shards)
    held = {r.shard: r.n for r in sent.selectExpr("shard", "octet_length(size) div 2 AS n").groupBy("shard").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert max(held.values()) < 2 * sum(held.values()) / shards  # one anchor alone would be all of a shard's
    for shard_bytes in (1 << 14, exact_dedup.SHARD):  # split and whole give the same
        assert _rows(exact_dedup.cut(df, length, block_bytes=1 << 15, shard_bytes=shard_bytes).collect()) == _brute(rows, length)


@pytest.mark.parametrize("at_once", [1, 300, 1 << 20])  # the first two use the scratch file
def test_a_shard_holds_each_distinct_segment_once(at_once):
    draw = random.Random(5)
    length, hot = 20, bytes(draw.choice(b"abcd") for _ in range(40))
    sent = [[(doc, hot[a : a + draw.randint(length, 25)]) for a in draw.sample(range(15), 6)] for doc in draw.sample(range(200), 200)]
    sent += [[(doc, bytes(draw.choice(b"ab") for _ in range(24))) for _ in range(3)] for doc in range(200, 240)]
    shard = exact_dedup.Shard(length, at_once)
    for block, entries in enumerate(sent):
        shard.add(block, np.array([d for d, _ in entries], "<i8").tobytes(), np.array([len(x) for _, x in entries], "<u2").tobytes(), exact_dedup._shrunk(b"".join(x for _, x in entries)))
    least = {}
    for d, x in (e for entries in sent for e in entries):
        # windows are looked for among segments of one anchor, as equal windows in whole texts have one
        for o in range(len(x) - length + 1):
            least[x[o : o + length]] = min(d, least.get(x[o : o + length], d))
    got = {}
    for blocks, counts, bits in shard.earlier():
        for b, part in zip(blocks.tolist(), np.split(bits, np.cumsum(counts)[:-1]), strict=True):
            got[b] = part.tolist()
    assert (shard.file is not None) == (at_once < 1000)
    assert len(shard.key) == len({x for entries in sent for _, x in entries})
    assert sorted(got) == list(range(len(sent)))
    same = exact_dedup.Shard(length, 1 << 30)
    for block, entries in enumerate(sent):
        same.add(block, np.array([d for d, _ in entries], "<i8").tobytes(), np.array([len(x) for _, x in entries], "<u2").tobytes(), exact_dedup._shrunk(b"".join(x for _, x in entries)))
    assert got == {b: p.tolist() for blocks, counts, bits in same.earlier() for b, p in zip(blocks.tolist(), np.split(bits, np.cumsum(counts)[:-1]), strict=True)}
    for b, entries in enumerate(sent):
        for (d, x), mask in zip(entries, got[b], strict=True):
            for o in range(len(x) - length + 1):
                assert not mask >> o & 1 or least[x[o : o + length]] < d


def test_only_what_can_match_is_sorted(monkeypatch):
    """Segments of one anchor in contexts that differ on both sides of it go past the sort; those with one side in common don't, and are found."""
    draw = random.Random(9)
    text = lambda n: bytes(draw.choice(b"abcdefgh") for _ in range(n))
    sorted_ = []
    monkeypatch.setattr(exact_dedup, "suffixes", lambda x: sorted_.append(len(x)) or induced.suffixes(x))

    def segments(whole):
        block = exact_dedup.Block(np.array([0], "<i8").tobytes() + b"\0\0", np.array([0, len(whole)], "<i8").tobytes(), exact_dedup._shrunk(whole), 50)
        return [(int(a), whole[s : s + w + 49]) for s, w, a in zip(block.start, block.windows, block.anchor, strict=True)]

    gram = min((text(16) for _ in range(20_000)), key=lambda g: int(exact_dedup.run_hashes(exact_dedup.prefix_hashes(np.frombuffer(g, np.uint8)), 16)[0]))
    anchor = segments(gram + text(34))[0][0]
    wholes = [text(40) + gram + text(40) for _ in range(300)]
    shared = text(40) + gram + text(17)
    for own, count in ((wholes, 0), ([*wholes, shared + text(23), shared + text(23)], 2)):
        shard = exact_dedup.Shard(50, 1 << 20)
        for block, whole in enumerate(own):
            entries = [x for a, x in segments(whole) if a == anchor]
            shard.add(block, np.full(len(entries), block, "<i8").tobytes(), np.array([len(x) for x in entries], "<u2").tobytes(), exact_dedup._shrunk(b"".join(entries)))
        sorted_.clear()
        bits = {b: m for blocks, counts, found in shard.earlier() for b, m in zip(np.repeat(blocks, counts).tolist(), found.tolist(), strict=True)}
        assert len(bits) > 250 and sum(sorted_) <= count * 86
        assert {b for b, m in bits.items() if m} == ({301} if count else set())


@pytest.mark.parametrize("length", [1, 16, 40])
def test_hashes_of_all_spans(length):
    prefix = exact_dedup.prefix_hashes(np.frombuffer(random.Random(2).randbytes(3000), np.uint8))
    at = np.arange(3001 - length)
    assert (exact_dedup.run_hashes(prefix, length) == exact_dedup.span_hashes(prefix, at, at + length)).all()


def test_blocks_grow_with_the_input(spark, monkeypatch):
    assert [exact_dedup.grown(2 << 20, n) for n in (0, 1 << 30, 3 << 29, 1 << 40)] == [2 << 20, 2 << 20, 3 << 20, 8 << 20]
    monkeypatch.setattr(exact_dedup, "MANY_BLOCKS", 4)
    draw = random.Random(6)
    shared = ["".join(draw.choice("abc ") for _ in range(80)) for _ in range(20)]
    rows = [(i, None if i % 50 == 0 else draw.choice(shared) + draw.choice(shared)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert _rows(exact_dedup.cut(df, 50, block_bytes=5000).collect()) == _brute(rows)
