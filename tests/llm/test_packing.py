import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from blockstrata.llm import packing, queries


def _check(rows, lengths):
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
    for own in bins.values():
        own.sort(key=lambda r: (r.offset, r.n_tokens))
        used = 0
        for r in own:
            assert r.offset == used
            used += r.n_tokens
        assert {r.used for r in own} == {used} and {r.length for r in own} == {next(x for x in sorted(lengths) if x >= used)}
    return bins


def test_pack_is_tight():
    draw = random.Random(1)
    sizes = sorted((draw.choice([30, 300, 900, 3000, 8192]) + draw.randrange(500) for _ in range(4000)), reverse=True)
    sizes = [min(s, 8192) for s in sizes]
    used = defaultdict(int)
    for (b, at), s in zip(packing.pack(sizes), sizes, strict=True):
        assert used[b] == at
        used[b] += s
    room = sum(next(x for x in packing.LENGTHS if x >= u) for u in used.values())
    assert sum(sizes) > 0.97 * room


def test_least_cost_bin_and_best_fit():
    assert packing.pack([10], (16, 64)) == [(0, 0)]
    assert packing.pack([40, 20, 4], (64,)) == [(0, 0), (0, 40), (0, 60)]
    out = packing.pack([50, 40, 14, 20], (64,))
    assert out[2] == (0, 50) and out[3] == (1, 40)  # each where least room is left


def test_query(spark, odd, none, as_dir):
    out = queries.op2_packing(spark, as_dir(documents=odd)).collect()
    _check(out, packing.LENGTHS)
    pieces = defaultdict(list)
    for r in out:
        pieces[(r.doc_id, r.n_ids)].append(r)
    assert sum(len(v) == 4 for v in pieces.values()) == 1  # 30,000 words
    for (_, n), own in pieces.items():
        if len(own) > 1 and own[0].doc_id != 6:
            own.sort(key=lambda r: r.piece)
            assert [r.piece for r in own] == list(range(len(own))) and sum(r.n_tokens for r in own) == n and all(r.start == 8192 * r.piece for r in own)
    assert queries.op2_packing(spark, as_dir(documents=none)).collect() == []


def test_null_and_negative_sizes(spark):
    df = spark.createDataFrame([(1, None), (2, -5), (3, 10), (3, 10)], "doc_id long, n long").withColumn("BIN", F.lit("clash"))
    out = packing.pack_sequences(df, "n", (16, 32)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == [(1, 0), (2, 0), (3, 10), (3, 10)]
    _check(out, (16, 32))


def _plain(sizes, lengths, overhead):
    """Best fit by looking at every open bin; the length to open by adding up what would still fit."""
    bins, out = [], []
    for i, size in enumerate(sizes):
        fitting = [(room, -last, b) for b, (room, last) in enumerate(bins) if room >= size]
        if fitting:
            _, _, b = min(fitting)
        else:
            costs = []
            for length in sorted(lengths):
                if length >= size:
                    rest = sum(s for s in sizes[i + 1 :] if s <= length - size)
                    costs.append(((length + overhead) / max(1, size + min(length - size, rest)), length))
            b = len(bins)
            bins.append((min(costs)[1], 0))
        room, _ = bins[b]
        bins[b] = (room - size, i + 1)  # of bins with equal room the one touched last comes first
        out.append(b)
    return out


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_by_brute_force(seed):
    draw = random.Random(seed)
    lengths = draw.choice([(16,), (16, 32), (10, 25, 64), (8, 16, 32, 64)])
    sizes = sorted((draw.randrange(max(lengths) + 1) for _ in range(draw.choice([1, 5, 60, 200]))), reverse=True)
    overhead = draw.choice([0, 3, 64])
    got = packing.pack(sizes, lengths, overhead)
    assert [b for b, _ in got] == _plain(sizes, lengths, overhead)
    filled = defaultdict(int)
    for (b, at), s in zip(got, sizes, strict=True):
        assert at == filled[b]
        filled[b] += s


def test_own_names_may_clash(spark):
    df = spark.createDataFrame([(3, 10, 1, 2)], "doc_id long, n long, _whole int, whole int")
    (r,) = packing.pack_sequences(df, "n", (16, 32)).collect()
    assert (r._whole, r.whole, r.n_tokens, r.length) == (1, 2, 10, 16)
