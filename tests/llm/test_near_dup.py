import random
import re

import pytest

from blockstrata.llm import components, near_dup, queries


def _brute(rows, words, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    at = {d: d for d in sets}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                at[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_by_brute_force(spark, words, percent, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)  # so that buckets are cut into blocks
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(draw.randrange(30)) for _ in range(60))) for i in range(40)]
    for i in range(40, 260):  # chains and clouds of edits around the threshold
        w = draw.choice(rows[-60:] if i % 2 else rows[:8])[1].split()
        for _ in range(draw.choice([0, 1, 1, 2, 2, 3])):
            w[draw.randrange(len(w))] = "new" + str(draw.randrange(1000))
        rows.append((i, " ".join(w).replace("a", "A") if i % 3 else "\t".join(w)))
    draw.shuffle(rows)
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out} == _brute(rows, words, percent)


def test_odd_and_empty(spark, odd, none, as_dir):
    out = queries.op7_near_dup(spark, as_dir(documents=odd)).collect()
    assert len(out) == 18
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == [(0, 1, True)] and by[2] == [(0, 2, True)] and by[6] == [(13, 0, False)] * 2 and by[11] == [(1, 11, True)] and by[5] == [(1, 5, True)]
    assert sorted(by[None]) == [(0, None, True), (1, None, True)]
    assert queries.op7_near_dup(spark, as_dir(documents=none)).collect() == []


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).read().collect()}
    at = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            at[a] = at[b] = min(at[a], at[b])
    assert got == {x: m for x, m in at.items() if x != m}


def test_one_component_that_fills_buckets(spark, monkeypatch):
    """A large group of copies and near copies, texts beside it that share bands but are no links, small blocks."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "WEIGHT", 300)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    near = lambda n: " ".join(draw.choice(["x", "y", "z"]) + str(draw.randrange(99)) if i in spots else w for spots in [set(draw.sample(range(60), n))] for i, w in enumerate(base))
    rows = [(i, " ".join(base)) for i in range(150)] + [(200 + i, near(draw.choice([1, 1, 2, 3, 4]))) for i in range(90)] + [(400 + i, " ".join(f"v{draw.randrange(5000)}" for _ in range(30))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for words, percent in ((3, 70), (2, 80)):
        got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, words, percent).collect()}
        sets = {d: {tuple(t.split()[i : i + words]) for i in range(len(t.split()) - words + 1)} for d, t in rows}
        assert got == _reach(sets, percent)
    assert len(set(got.values())) > 30


def _reach(sets, percent):
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: top(d) for d in sets}


def test_components_with_a_hub(spark, monkeypatch):
    edges = [(5, k) for k in range(10, 2600)] + [(k, k + 1) for k in range(3000, 3040)] + [(2599, 3000), (7000, 7001), (8, 8), (None, 3)]
    got = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).read().collect()}
    assert got == {**{k: 5 for k in [*range(10, 2600), *range(3000, 3041)]}, 7001: 7000}
    assert components.components(spark.createDataFrame([], "u long, v long")).read().collect() == []
