import numpy as np
import pytest

from blockstrata.llm import ann, queries


def _brute(ids, x, every=20, most=20):
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = np.zeros(len(ids))
        for d in range(x.shape[1]):
            score += x[:, d].astype(float) * float(x[q, d])
        order = [i for i in np.lexsort((ids, -score)) if i != q][:most]
        out[int(ids[q])] = [(int(ids[i]), float(score[i])) for i in order]
    return out


@pytest.mark.parametrize(("sf", "block"), [("sf0.1", 200), ("sf0.1", 700), ("sf0.1", ann.BLOCK), ("sf0.01", 100), ("sf0.01", ann.BLOCK), ("sf0.001", ann.BLOCK)])
def test_recall(spark, sf, block):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = sorted(df.collect(), key=lambda r: r.vec_id)
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    want, got = _brute(ids, x), {}
    for r in ann.search(ann.build(df, block=block)).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 20 * len(want)
    exact = {q: dict(w) for q, w in _brute(ids, x, most=len(ids)).items()}
    for q, found in got.items():
        listed = [found[k] for k in sorted(found)]
        assert listed == sorted(listed, key=lambda p: (-p[1], p[0])) and all(exact[q][v] == s for v, s in listed)


def test_odd_vectors(spark, as_dir):
    good = [[float(i % 7), 1.0, -float(i % 5)] for i in range(60)]
    rows = [(i, v) for i, v in enumerate(good)] + [(20, good[20]), (100, None), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 2.0]), (160, [float("nan"), 1.0, 1.0]), (180, [float("inf"), 1.0, 1.0]), (200, [1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(1000 + i, [3.0, 3.0, 3.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumnRenamed("vec_id", "vec_id").selectExpr("*", "1 AS rank", "'x' AS score")
    out = queries.op8_ann(spark, as_dir(embeddings=df)).collect()
    ids = np.array([i for i, _ in rows if i is not None and (i < 60 or i >= 1000)])
    ids, first = np.unique(ids, return_index=True)
    want = _brute(ids, np.array([*good, *[[3.0, 3.0, 3.0]] * 400], np.float32))
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert got[20][0][1] == want[20][0][1] and got[1000] == want[1000]  # ties go to the smaller id
    assert queries.op8_ann(spark, as_dir(embeddings=df.limit(0))).collect() == []


def test_fewer_rows_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ann.search(ann.build(df)).collect()] == [(0, 1, 1, 4.0)]


@pytest.mark.parametrize("block", [2, 100])
def test_rows_of_one_id(spark, block):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [3.0, 1.0]), (1, [1.0, 4.0]), (1, [1.0, 4.0]), (2, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.search(ann.build(df, block=block)).collect()]
    one = [(0, 1, 1, 3.0), (0, 2, 2, 2.0), (0, 3, 1, 1.0), (0, 4, 0, 0.0)]  # asked by the first row of id 0, then by the second
    two = [(0, 1, 1, 8.0), (0, 2, 2, 4.0), (0, 3, 1, 2.0), (0, 4, 0, 0.0)]
    assert sorted(got) == sorted(one + two)


def test_a_task_combines_what_its_blocks_find(spark, monkeypatch):
    """The same result whether a task holds all, some or next to nothing of what it finds."""
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    out = []
    for held in (10, 700, ann.MOST_HELD):
        monkeypatch.setattr(ann, "MOST_HELD", held)
        out.append(sorted(map(tuple, ann.search(ann.build(df, block=40)).collect())))
    assert out[0] == out[1] == out[2] and len(out[0]) == 25 * 20


def test_a_vector_that_a_third_of_all_rows_have(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(900, 8)).astype(np.float32)
    x[draw.permutation(900)[:300]] = x[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    index = ann.build(df, block=100)
    held = index.blocks.read().selectExpr("octet_length(ids) AS n", "octet_length(names) AS k").collect()
    assert index.count == 601 and sum(r.n for r in held) <= 8 * (600 + 21) and max(r.k for r in held) <= 16 * 150
    got, want = {}, _brute(np.arange(900), x)
    for r in sorted(ann.search(index).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    hot = [q for q in got if (x[q] == x[7]).all()]
    assert hot and all(got[q] == want[q] for q in hot)  # ties go to the smaller ids, none to the row itself
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in got) >= 0.9 * 20 * len(got)


def test_parts_grow_with_the_rows_and_queries_go_to_few(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(40, 16)) * 4
    x = np.concatenate([c + draw.normal(size=(60, 16)) for c in centres])
    coarse = ann.Coarse.fit(x, 40, 20)
    coarse.rows = np.bincount(coarse.nearest(x), minlength=len(coarse.centres))
    coarse.blocks = -(-coarse.rows // 50)
    coarse.first = np.cumsum(coarse.blocks) - coarse.blocks
    row, block = coarse.probed(x[::20], 100)
    assert coarse.probes < 20 and len(block) < 0.6 * len(x[::20]) * coarse.blocks.sum() and block.max() < coarse.blocks.sum()
    assert set(row) == set(range(len(x[::20])))


@pytest.mark.parametrize("kind", ["close together", "queries of another kind", "lengths apart", "too long for single precision"])
def test_none_is_missed(spark, kind):
    """Rows that codes cannot tell apart, queries that the parts' sample says nothing of, and lengths that no centre has."""
    draw, n = np.random.default_rng(12), 3000
    x, centres = draw.normal(size=(n, 16)), draw.normal(size=(12, 16))
    if kind == "close together":
        x = centres[draw.integers(0, 12, n)] + 0.01 * x
    elif kind == "queries of another kind":
        x[1::2] = 2 * centres[draw.integers(0, 12, n // 2)] + 0.2 * x[1::2]
    elif kind == "lengths apart":
        x *= np.exp(3 * draw.normal(size=(n, 1)))
    else:
        x *= 1e25
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in sorted(ann.search(ann.build(df, block=500)).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == _brute(np.arange(n), x)
