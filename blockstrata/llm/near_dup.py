"""Near duplicates: minima of many universal hashes, banding, checked signatures, exact sets, components.

A document's set holds its distinct shingles of ``words`` words (A-Z lower-cased);
with fewer words the whole sequence is one. Equal sets form a class, and only one
document of a class goes on. Its minima under many universal hashes are cut into
bands; classes that share a band are candidates. The number of bands is chosen so
that a pair at the threshold shares none with a chance under 1e-7.

No bucket is expanded into pairs. First each class is tested against the smallest
class of one of its buckets, the one whose signature agrees best. Components of the
links found come next. Only where a bucket still holds two components or more are
its members' signatures compared across them, and of the pairs that may be linked a
spanning forest is kept, at most one row a member. Its trees are the clusters in which
links can remain: there each two classes of different components are tested on full
sets, again keeping a spanning forest. Comparisons run in tasks of two blocks of
bounded size, and blocks of one component don't meet; what they return grows with the members,
not with their pairs. What is known of a group of a thousandth of all rows or more goes to its rows by
broadcast (there are few), so a group of copies or a bucket never meets in one task. Every
link is confirmed on full sets, and every pair that may be linked is tested unless its
ends are already connected.

Defined results: null or wordless texts have an empty set and are linked with nothing;
rows of one doc_id are one document; a null doc_id is linked with nothing, has a null
component and is kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockstrata.llm._base import AT_ONCE, Staged, grouped, join_groups, small_batches, spread, text_chunks, tidied
from blockstrata.llm._words import U64, Texts, mix, runs
from blockstrata.llm.components import components

BAND = 5
MISS = 1e-7
#: Standard deviations below the threshold at which signatures still count as agreeing.
SLACK = 5.5
#: Classes whose ids are handed to every task; beyond, they are joined by shuffle.
MOST_BROADCAST = 1_000_000
#: Members of a bucket or cluster in a block, and shingles in a block of full sets; a task compares two blocks.
BLOCK, WEIGHT = 1024, 1 << 18


def bands_for(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND))


def least_agreement(percent: int, hashes: int) -> int:
    """Equal minima that a pair at the threshold has but for a negligible chance."""
    p = percent / 100
    return max(1, math.floor(hashes * (p - SLACK * math.sqrt(p * (1 - p) / hashes))))


def shingle_sets(t: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes laid end to end, offsets of each text's) of a chunk."""
    one, texts = t.words(), len(t.offs) - 1
    full = runs(one, words)
    n = np.diff(t.first)
    owner = np.searchsorted(t.first, np.arange(len(full)), side="right") - 1
    inside = np.arange(len(full)) + words <= t.first[owner + 1] if len(full) else np.zeros(0, bool)
    hashes, owner = [full[inside]], [owner[inside]]
    for short in range(1, words):  # with fewer words the whole sequence is the only shingle
        at = np.flatnonzero(n == short)
        hashes.append(runs(one, short)[t.first[at]])
        owner.append(at)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    first = np.unique(mix(hashes ^ mix(owner.astype(np.uint64) + U64(1))), return_index=True)[1]
    first = first[np.argsort(owner[first], kind="stable")]
    return hashes[first], np.searchsorted(owner[first], np.arange(texts + 1))


def _family(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11)
    return draw.integers(0, 1 << 63, hashes, dtype=np.uint64) * U64(2) + U64(1), draw.integers(0, 1 << 63, hashes, dtype=np.uint64)


def minima(values: np.ndarray, offs: np.ndarray, hashes: int) -> np.ndarray:
    """(texts, hashes) least values of each universal hash over each set; zeros for an empty one."""
    out = np.zeros((len(offs) - 1, hashes), np.uint32)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        for j, (a, b) in enumerate(zip(*_family(hashes), strict=True)):
            out[full, j] = np.minimum.reduceat(values * a + b, offs[full]) >> U64(32)
    return out


def _rows(signatures: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(signatures, "<u4")], pa.binary())


def _signed(docs: DataFrame, words: int, hashes: int) -> DataFrame:
    """doc_id, n_shingles, h1 and h2 (the class), signature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e, raw, offs in text_chunks(batch.column(1), AT_ONCE):
                values, at = shingle_sets(Texts(raw, offs, lower=True), words)
                sums = []
                for seed in (1, 2):
                    total = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(mix(values ^ U64(pow(0x9E3779B97F4A7C15, seed, 1 << 64))), out=total[1:])
                    sums.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, e - a), pa.array(np.diff(at).astype(np.int64)), *sums, _rows(minima(values, at, hashes))], ["doc_id", "n_shingles", "h1", "h2", "signature"])

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, n_shingles long, h1 long, h2 long, signature binary")


def _signatures(column: pa.Array) -> np.ndarray:
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<u4").reshape(len(parts), -1)


def _banded(classes: DataFrame, bands: int) -> DataFrame:
    """rep, key: a row for each band."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 2000):
            sig = _signatures(batch.column(1)).astype(np.uint64).reshape(batch.num_rows, bands, BAND)
            key = np.full((batch.num_rows, bands), 0, np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for k in range(BAND):
                key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), bands)), pa.array(key.view(np.int64).ravel())], ["rep", "key"])

    return classes.select("rep", "signature").mapInArrow(tidied(run), "rep long, key long")


def _agreement(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with ``same``, how many minima of theirs are equal."""
    sig = classes.select("rep", "signature")
    both = pairs.join(sig.select(F.col("rep").alias("x"), F.col("signature").alias("sx")), "x").join(sig.select(F.col("rep").alias("y"), F.col("signature").alias("sy")), "y").select("x", "y", "sx", "sy")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4000):
            same = (_signatures(batch.column(2)) == _signatures(batch.column(3))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same.astype(np.int32))], ["x", "y", "same"])

    return both.mapInArrow(tidied(run), "x long, y long, same int")


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep, members: the sorted shingle hashes of the wanted classes, read anew from their documents' whole texts."""
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, e, raw, offs in text_chunks(batch.column(1), AT_ONCE):
                values, at = shingle_sets(Texts(raw, offs, lower=True), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, e - a), pa.array([np.sort(values[at[i] : at[i + 1]]).tobytes() for i in range(e - a)], pa.binary())], ["rep", "members"])

    return rows.mapInArrow(tidied(run), "rep long, members binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (x, y) with ``linked``: 100 * intersection >= percent * union, on full sets."""
    both = pairs.select("x", "y").join(sets.select(F.col("rep").alias("x"), F.col("members").alias("mx")), "x").join(sets.select(F.col("rep").alias("y"), F.col("members").alias("my")), "y").select("x", "y", "mx", "my")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 256):
            linked = []
            for mx, my in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(mx, np.uint64), np.frombuffer(my, np.uint64)
                common = 0
                if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["x", "y", "linked"])

    return both.mapInArrow(tidied(run), "x long, y long, linked boolean")


def _blocked(members: DataFrame, payload: DataFrame, size: Column, count: int) -> DataFrame:
    """Members (key, rep, comp) of each key dealt to blocks of ``size`` one, with their payload (rep, payload): a row for each two blocks they are in.

    A component that fills half a block has blocks of its own. Those never meet each other, as what is in one component
    is compared no more, so a key of which one component has most members takes meetings in proportion to the others.
    """
    parts = members.groupBy("key", "comp").agg(size.alias("w"), F.count("*").alias("k"))
    large = F.col("w") >= 0.5
    keys = parts.groupBy("key").agg(F.sum("k").alias("n"), F.ceil(F.sum(F.when(~large, F.col("w")))).cast("int").alias("rest"), F.sort_array(F.collect_list(F.when(large, F.struct("comp", F.ceil("w").cast("int").alias("parts"))))).alias("own"))
    label = lambda big, comp, at: F.struct(big.alias("big"), comp.alias("comp"), at.cast("int").alias("at"))
    ours = F.flatten(F.transform("own", lambda o: F.transform(F.sequence(F.lit(0), o["parts"] - 1), lambda i: label(F.lit(True), o["comp"], i))))
    theirs = F.when(F.col("rest") > 0, F.transform(F.sequence(F.lit(0), F.col("rest") - 1), lambda i: label(F.lit(False), F.lit(0).cast("long"), i)))
    keys = keys.withColumn("labels", F.concat(ours, F.coalesce(theirs, F.slice(ours, 1, 0))))
    mine = F.get(F.filter("own", lambda o: o["comp"] == F.col("comp")), F.lit(0))
    dealt = join_groups(members, keys, ["key"], count).withColumn("mine", mine)
    where = F.pmod(F.xxhash64("rep"), F.coalesce(F.col("mine.parts"), F.col("rest")))
    dealt = dealt.withColumn("label", label(F.col("mine").isNotNull(), F.when(F.col("mine").isNotNull(), F.col("comp")).otherwise(F.lit(0).cast("long")), where))
    dealt = dealt.withColumn("block", (F.array_position("labels", F.col("label")) - 1).cast("int"))
    paired = dealt.join(payload, "rep").select("key", "rep", "comp", *(["size"] if "size" in members.columns else []), "payload", "block", F.posexplode("labels").alias("other", "l"))
    paired = paired.where(~(F.col("l.big") & (F.col("l.comp") == F.col("comp"))))
    rows = paired.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "rep", "comp", "payload")
    return rows.repartition(spread(members.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b")


class _Forest:
    """Spanning edges among the members of one task."""

    def __init__(self, comp: np.ndarray, rep: np.ndarray) -> None:
        self.label, self.rep = np.unique(comp, return_inverse=True)[1], rep
        self.edges: list[tuple[int, int]] = []

    def link(self, i: int, others: np.ndarray) -> None:
        labels, first = np.unique(self.label[others], return_index=True)
        for c, k in zip(labels.tolist(), first.tolist(), strict=True):
            if c != self.label[i]:
                self.edges.append((int(self.rep[i]), int(self.rep[others[k]])))
                self.label[self.label == c] = self.label[i]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    x, y = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])


def _perhaps(members: DataFrame, signatures: DataFrame, need: int, count: int) -> DataFrame:
    """Spanning edges (x, y) of the pairs in a bucket (key, rep, comp) that agree in ``need`` minima and lie in different components."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs in grouped(iter(batches), 3):
            a, b, block, rep, comp = (rows.column(k).to_numpy() for k in range(1, 6))
            sig, out = _signatures(rows.column(6)), []
            for s, e in zip(offs[:-1], offs[1:], strict=True):
                forest = _Forest(np.arange(e - s), rep[s:e])
                for i in range(e - s):
                    far = (comp[s:e] != comp[s + i]) & (forest.label != forest.label[i])
                    if a[s] != b[s]:
                        far &= block[s:e] != block[s + i]
                    far = np.flatnonzero(far)
                    if len(far):
                        forest.link(i, far[(sig[s + far] == sig[s + i]).sum(1) >= need])
                out += forest.edges
            yield _edges(out)

    return _blocked(members, signatures, F.count("*") / BLOCK, count).mapInArrow(tidied(run), "x long, y long")


def _links(members: DataFrame, sets: DataFrame, percent: int, count: int) -> DataFrame:
    """Spanning edges (x, y) of the links in a cluster (key, rep, comp, size) between different components."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs in grouped(iter(batches), 3):
            a, b, block, rep, comp = (rows.column(k).to_numpy() for k in range(1, 6))
            for s, e in zip(offs[:-1], offs[1:], strict=True):
                held = [np.frombuffer(x, np.uint64) for x in rows.column(6).slice(s, e - s).to_pylist()]
                size = np.array([len(x) for x in held])
                at = np.concatenate([[0], np.cumsum(size)])
                unique, flat = np.unique(np.concatenate(held), return_inverse=True)
                mark, forest = np.zeros(len(unique), bool), _Forest(comp[s:e], rep[s:e])
                for i in range(e - s):
                    far = (forest.label != forest.label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
                    if a[s] != b[s]:
                        far &= block[s:e] != block[s + i]
                    far = np.flatnonzero(far)
                    if not len(far):
                        continue
                    mark[flat[at[i] : at[i + 1]]] = True
                    own = size[far]
                    first = np.cumsum(own) - own
                    hits = mark[flat[np.arange(int(own.sum())) + np.repeat(at[far] - first, own)]]
                    mark[flat[at[i] : at[i + 1]]] = False
                    common = np.add.reduceat(hits.astype(np.int64), first)
                    forest.link(i, far[100 * common >= percent * (own + size[i] - common)])
                yield _edges(forest.edges)

    return _blocked(members, sets, F.greatest(F.count("*") / BLOCK, F.sum("size") / WEIGHT), count).mapInArrow(tidied(run), "x long, y long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, left: list[Staged] | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (doc_id = component_id), one row for each row of ``docs`` (doc_id, text). ``left`` gets the tables that the result reads."""
    bands = bands_for(percent)
    hashes = bands * BAND
    need = least_agreement(percent, hashes)
    signed = Staged(_signed(docs, words, hashes), "signed")
    some = signed.read().where("n_shingles > 0 and doc_id is not null")
    least = some.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    member = Staged(join_groups(some.select("doc_id", "h1", "h2"), least, ["h1", "h2"], some.count()).select("doc_id", "rep").distinct(), "member")
    # a doc_id with several texts links their classes
    same_doc = member.read().where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    first = some.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "signature")).alias("one"))
    classes = Staged(first.select(F.col("one.doc_id").alias("rep"), F.col("one.signature").alias("signature")), "classes")
    banded = Staged(_banded(classes.read(), bands), "banded")
    shared = banded.read().groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), F.count("*").alias("n")).where("first <> last")
    bucket = Staged(join_groups(banded.read(), shared.select("key", "first", "n"), ["key"], banded.read().count()), "bucket")
    banded.drop()
    star = bucket.read().where("rep <> first").select(F.col("rep").alias("x"), F.col("first").alias("y")).distinct()
    scored = _agreement(star, classes.read()).where(F.col("same") >= need)
    best = Staged(scored.groupBy("x").agg(F.max(F.struct("same", (-F.col("y")).alias("y"))).alias("b")).select("x", (-F.col("b.y")).alias("y")), "best")
    sets = Staged(_full_sets(docs, best.read().select(F.col("x").alias("rep")).unionByName(best.read().select(F.col("y").alias("rep"))).distinct(), words), "sets")
    links = Staged(_confirmed(best.read(), sets.read(), percent).where("linked").select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(same_doc), "links")
    for t in (best, sets):
        t.drop()
    label = components(links.read())
    of = lambda frame: frame.join(label.read().select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    labelled = of(bucket.read().select("key", "rep"))
    apart = labelled.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n")).where("c1 <> c2").select("key", "n")
    divided = Staged(join_groups(labelled, apart, ["key"], bucket.read().count()), "divided")
    perhaps = Staged(_perhaps(divided.read(), classes.read().withColumnRenamed("signature", "payload"), need, divided.read().count()), "perhaps")
    cluster = components(perhaps.read().select(F.col("x").alias("u"), F.col("y").alias("v")))
    inside = perhaps.read().select(F.col("x").alias("rep")).unionByName(perhaps.read().select(F.col("y").alias("rep"))).distinct()
    inside = Staged(of(inside).join(cluster.read().select(F.col("u").alias("rep"), F.col("v").alias("key")), "rep", "left").withColumn("key", F.coalesce("key", "rep")), "inside")
    sets = Staged(_full_sets(docs, inside.read().select("rep"), words), "sets")
    sized = inside.read().join(sets.read().groupBy("rep").agg(F.max(F.octet_length("members") / 8).alias("size")), "rep")
    more = Staged(_links(sized, sets.read().withColumnRenamed("members", "payload"), percent, inside.read().count()).select(F.col("x").alias("u"), F.col("y").alias("v")), "more")
    for t in (bucket, divided, classes, perhaps, cluster, inside, sets, label):
        t.drop()
    label = components(links.read().unionByName(more.read()))
    for t in (links, more):
        t.drop()
    if left is not None:
        left += [signed, member, label]
    comp = member.read().groupBy("doc_id").agg(F.min("rep").alias("rep"))
    comp = comp.join(label.read().select(F.col("u").alias("rep"), F.col("v").alias("comp")), "rep", "left").select("doc_id", F.coalesce("comp", "rep").alias("comp"))
    out = signed.read().select("doc_id", "n_shingles").join(comp, "doc_id", "left").withColumn("component_id", F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
