"""Largest inner products by score-aware quantisation, four-bit table scans and exact reranking.

Vectors are cut into subspaces of two dimensions with sixteen centres each. Centres and
codes minimise |r|^2 + (eta - 1) * (r . x/|x|)^2 of the residual r: the part parallel to
the vector, which changes its inner products with the queries that matter, weighs eta times
the rest. Codes are found by coordinate descent over subspaces, centres by the
normal equations of the same loss. A scan sums, for each row, one table entry for each
pair of codes; the best rows of a block are scored again on the original vectors, and with
them all that what the codes miss of a vector (its residual's length, kept for each row)
could lift among the best: where codes cannot tell rows apart, more are scored.

Equal vectors are one class, which stands for its smallest ids: more of them than are asked
for can never be found, so nothing is lost. Classes lie in parts around coarse centres, as
many as the input needs, and parts in blocks of bounded size. A query goes to the parts whose
centres score best; how many, is measured when the index is built: as many as hold nearly
all true neighbours of queries drawn from the sample, all parts if it takes all (as it does
for vectors without any structure, where nothing but a scan finds neighbours). Then a query goes
to each other part that could hold a better row than it has found, as the part's centre and
radius say. So nothing but rounding can miss a neighbour, whatever the rows. Where few
parts can have one, what is shuffled, scanned and held grows with the rows and not with their pairs; a
part that is larger than others is only more blocks.

Defined results: vectors that are null, zero, of another length than most, or hold a null
or non-finite component take no part, nor do null ids; rows equal in id and vector count
once, others of one id are rows of their own, each asked and found; a row does not find
itself; ranks count from 1 for each row that asks; ties go to the smaller id; where there are
fewer candidates than asked for all are found; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockstrata.llm._base import Staged, grouped, small_batches, spread, tidied

SUB, CENTRES = 2, 16
#: Vectors on which centres are fitted and probes measured, drawn by a hash: so many at least, and for many parts so many each, up to a bound.
SAMPLE, SAMPLE_EACH, MOST_SAMPLE = 8192, 16, 65536
#: Rows of a block, and parts at most; a part is made for half a block of rows.
BLOCK, MOST_PARTS = 4096, 4096
#: The share of true neighbours in a sample that the probed parts must hold.
COVERED = 0.985
#: Queries that meet a block at once.
ASKED = 1024


def _parts(x: np.ndarray) -> np.ndarray:
    """(rows, subspaces, 2) and an even number of subspaces, padded with zeros."""
    width = -(-x.shape[1] // (2 * SUB)) * 2 * SUB
    out = np.zeros((len(x), width))
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), -1, SUB)


@dataclass
class Codebook:
    centres: np.ndarray  # (subspaces, 16, 2)
    eta: float

    def encode(self, x: np.ndarray, codes: np.ndarray | None = None, rounds: int = 2) -> np.ndarray:
        """(rows, subspaces) codes by coordinate descent on the score-aware loss."""
        xs = _parts(x)
        u = xs / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None, None]
        if codes is None:
            codes = np.stack([((xs[:, m, None] - self.centres[m]) ** 2).sum(2).argmin(1) for m in range(xs.shape[1])], 1)
        share = np.stack([((xs[:, m] - self.centres[m][codes[:, m]]) * u[:, m]).sum(1) for m in range(xs.shape[1])], 1)
        parallel = share.sum(1)
        rows = np.arange(len(x))
        for _ in range(rounds):
            for m in range(xs.shape[1]):
                r = xs[:, m, None] - self.centres[m]
                along = np.einsum("nks,ns->nk", r, u[:, m])
                rest = parallel - share[:, m]
                codes[:, m] = ((r**2).sum(2) + (self.eta - 1) * (rest[:, None] + along) ** 2).argmin(1)
                share[:, m] = along[rows, codes[:, m]]
                parallel = rest + share[:, m]
        return codes

    @staticmethod
    def fit(x: np.ndarray, threshold: float = 0.2, rounds: int = 6) -> Codebook:
        """Centres for vectors ``x``; ``threshold`` is the cosine above which scores matter."""
        xs, draw = _parts(x), np.random.default_rng(5)
        u = xs / np.linalg.norm(x, axis=1)[:, None, None]
        eta = max(1.0, threshold**2 / (1 - threshold**2) * (x.shape[1] - 1))
        start = xs[draw.integers(0, len(x), CENTRES)] + draw.normal(0, 1e-9, (CENTRES, *xs.shape[1:]))
        book, codes = Codebook(np.ascontiguousarray(start.transpose(1, 0, 2)), 1.0), None
        for step in range(rounds):
            book.eta = 1.0 if step < 2 else eta
            codes = book.encode(x, None if step < 3 else codes, 1)
            r = np.stack([xs[:, m] - book.centres[m][codes[:, m]] for m in range(xs.shape[1])], 1)
            share = (r * u).sum(2)
            parallel = share.sum(1)
            for m in range(xs.shape[1]):
                target = parallel - share[:, m] + (xs[:, m] * u[:, m]).sum(1)
                for k in range(CENTRES):
                    own = codes[:, m] == k
                    if own.any():
                        a = own.sum() * np.eye(SUB) + (book.eta - 1) * u[own, m].T @ u[own, m]
                        book.centres[m, k] = np.linalg.solve(a, xs[own, m].sum(0) + (book.eta - 1) * (u[own, m] * target[own, None]).sum(0))
                new = ((xs[:, m] - book.centres[m][codes[:, m]]) * u[:, m]).sum(1)
                parallel, share[:, m] = parallel - share[:, m] + new, new
        return book

    def missed(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The length of each row's residual."""
        r = _parts(x) - self.centres[np.arange(codes.shape[1]), codes]
        return np.sqrt((r**2).sum((1, 2)))

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, pairs of subspaces, 256): what each byte of two codes adds to a score, over each query's largest entry; that; and how far a sum of such entries can be off."""
        one = np.einsum("qms,mks->qmk", _parts(q), self.centres)
        out = (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(q), one.shape[1] // 2, 256)
        size = np.abs(out).max(2)
        scale = size.max(1)
        scale[scale == 0] = 1.0
        return (out / scale[:, None, None]).astype(np.float32), scale, (out.shape[1] + 2) * 1.2e-7 * size.sum(1)


@dataclass
class Coarse:
    """Part centres, how many parts a query goes to first, and of each part the rows, the largest distance from its centre, and the blocks: ``first`` to ``first`` + ``blocks``."""

    centres: np.ndarray
    probes: int = 1
    rows: np.ndarray | None = None
    radius: np.ndarray | None = None
    first: np.ndarray | None = None
    blocks: np.ndarray | None = None

    @staticmethod
    def fit(x: np.ndarray, parts: int, most: int, rounds: int = 8, queries: int = 256) -> Coarse:
        """Centres by k-means on a sample, and the probes that its own neighbours take."""
        draw = np.random.default_rng(9)
        out = Coarse(x[np.sort(draw.choice(len(x), min(parts, len(x)), replace=False))].copy())
        for _ in range(rounds):
            part = out.nearest(x)
            sums, n = np.zeros_like(out.centres), np.bincount(part, minlength=len(out.centres))
            np.add.at(sums, part, x)
            out.centres[n > 0] = sums[n > 0] / n[n > 0, None]
        part, asked = out.nearest(x), draw.choice(len(x), min(queries, len(x)), replace=False)
        scores = x[asked] @ x.T
        scores[np.arange(len(asked)), asked] = -np.inf
        near = np.argsort(-scores, axis=1)[:, : min(most, max(1, len(x) - 1))]
        place = np.argsort(np.argsort(-(x[asked] @ out.centres.T), axis=1), axis=1)
        needed = np.sort(np.take_along_axis(place, part[near], axis=1).ravel())
        out.probes = int(needed[min(len(needed) - 1, int(np.ceil(COVERED * len(needed))))]) + 1
        return out

    def nearest(self, x: np.ndarray) -> np.ndarray:
        half = (self.centres**2).sum(1) / 2
        return np.concatenate([(x[i : i + 4096] @ self.centres.T - half).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)

    def _probed_parts(self, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(-(q @ self.centres.T), axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        row, at = np.nonzero((np.arange(order.shape[1]) < self.probes) | (before < least))
        return row, order[row, at]

    def _of_parts(self, row: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.blocks[part]
        return np.repeat(row, n), np.repeat(self.first[part] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def probed(self, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) of every block that a query meets first: those of its ``probes`` best parts, and of more until they have ``least`` rows."""
        return self._of_parts(*self._probed_parts(q, least))

    def left(self, q: np.ndarray, least: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, block) of every other block whose part can hold a row with a query's score of ``scores`` or more."""
        length = np.linalg.norm(q, axis=1)[:, None]
        most = q @ self.centres.T + length * (self.radius + 1e-9 * (self.radius + np.linalg.norm(self.centres, axis=1)))
        may = ~(most < scores[:, None]) & (self.rows > 0)
        may[self._probed_parts(q, least)] = False
        return self._of_parts(*np.nonzero(may))


@dataclass
class Index:
    asking: Staged  # c1, c2 (the class), id: every row
    classes: Staged  # c1, c2, v
    blocks: Staged  # block, names (16 bytes a class), counts, ids, codes, vectors, missed
    count: int
    dims: int
    dtype: str
    book: Codebook | None
    coarse: Coarse | None
    most: int


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dims).astype(float)


def _drawn(classes: DataFrame, sample: int) -> np.ndarray:
    return np.array([r.v for r in classes.orderBy("c1", "c2").limit(sample).select("v").collect()], float)


def build(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, block: int = BLOCK, most: int = 20) -> Index:
    """An index of every valid row, from which up to ``most`` neighbours can be asked for."""
    spark = df.sparkSession
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector)
    valid = df.where(F.col(ident).isNotNull() & v.isNotNull()).where(F.forall(v, fine)).where(F.exists(v, lambda x: x != 0)).select(F.col(ident).cast("long").alias("id"), v.alias("v"))
    size = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    kind = "<f8" if dict(df.dtypes)[vector] != "array<float>" else "<f4"
    dims = size[0] if size is not None else 0
    named = valid.where(F.size("v") == dims).select("id", F.xxhash64("v").alias("c1"), F.xxhash64("v", F.lit(1)).alias("c2"), "v")
    asking = Staged(named.select("c1", "c2", "id").distinct(), "ann_rows")
    # a hot vector's ids are cut to the smallest before they meet
    nth = F.row_number().over(Window.partitionBy("c1", "c2").orderBy("id"))
    least = asking.read().withColumn("nth", nth).where(F.col("nth") <= most + 1).groupBy("c1", "c2").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = Staged(named.groupBy("c1", "c2").agg(F.any_value("v").alias("v")).join(least, ["c1", "c2"]), "ann_classes")
    count = classes.read().count()
    if not count:
        return Index(asking, classes, classes, 0, dims, kind, None, None, most)
    parts = min(max(1, 2 * count // block), MOST_PARTS)
    x = _drawn(classes.read(), min(max(sample, SAMPLE_EACH * parts), MOST_SAMPLE))
    book, coarse = Codebook.fit(x[:SAMPLE]), Coarse.fit(x, parts, most)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 4096):
            x = _matrix(b.column(3), dims)
            codes = book.encode(x).astype(np.uint8)
            both = codes[:, 0::2] * 16 + codes[:, 1::2]
            part = coarse.nearest(x)
            far = np.linalg.norm(x - coarse.centres[part], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(b.column(k) for k in range(4)), pa.array([r.tobytes() for r in both], pa.binary()), pa.array(book.missed(x, codes)), pa.array(far)], ["part", "c1", "c2", "ids", "v", "codes", "missed", "far"])

    element = "double" if kind == "<f8" else "float"
    placed = Staged(classes.read().select("c1", "c2", "ids", F.col("v").cast(f"array<{element}>").alias("v")).mapInArrow(tidied(place), f"part int, c1 long, c2 long, ids array<long>, v array<{element}>, codes binary, missed double, far double"), "ann_placed")
    coarse.rows, coarse.radius = np.zeros(len(coarse.centres), np.int64), np.zeros(len(coarse.centres))
    for r in placed.read().groupBy("part").agg(F.count("*"), F.max("far")).collect():  # at most MOST_PARTS rows
        coarse.rows[r[0]], coarse.radius[r[0]] = r[1], r[2]
    coarse.blocks = -(-coarse.rows // block)
    coarse.first = np.cumsum(coarse.blocks) - coarse.blocks
    of = spark.createDataFrame([(k, int(f), int(n)) for k, (f, n) in enumerate(zip(coarse.first, coarse.blocks, strict=True)) if n], "part int, first int, n int")
    dealt = placed.read().join(F.broadcast(of), "part").select((F.col("first") + F.pmod("c1", "n")).cast("int").alias("block"), "c1", "c2", "ids", "v", "codes", "missed")
    dealt = dealt.repartition(spread(spark), "block").sortWithinPartitions("block", "c1", "c2")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs in grouped(iter(batches), 1):
            for s, e in zip(offs[:-1], offs[1:], strict=True):
                part = rows.slice(s, e - s)
                names = np.stack([part.column(k).to_numpy() for k in (1, 2)], 1).astype("<i8")
                counts, ids = np.diff(np.asarray(part.column(3).offsets)).astype("<i4"), part.column(3).flatten().to_numpy().astype("<i8")
                vectors = part.column(4).flatten().to_numpy().astype(kind)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), *(pa.array([x], pa.binary()) for x in (names.tobytes(), counts.tobytes(), ids.tobytes(), b"".join(part.column(5).to_pylist()), vectors.tobytes(), part.column(6).to_numpy().astype("<f8").tobytes()))], ["block", "names", "counts", "ids", "codes", "vectors", "missed"])

    blocks = Staged(dealt.mapInArrow(tidied(pack), "block int, names binary, counts binary, ids binary, codes binary, vectors binary, missed binary"), "ann_blocks")
    placed.drop()
    return Index(asking, classes, blocks, count, dims, kind, book, coarse, most)


def _best(scores: np.ndarray, most: int) -> np.ndarray:
    """Rows of the ``most`` largest scores; of equal ones at the border the first rows."""
    if len(scores) <= most:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - most)[len(scores) - most]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: most - len(above)]])


def _candidates(approx: np.ndarray, missed: np.ndarray, x: np.ndarray, q: np.ndarray, most: int, rerank: int, least: float, rounding: float) -> np.ndarray:
    """Rows of ``x`` that can be among the ``most`` best of ``q`` with a score of ``least`` or more, by the codes' scores ``approx`` and what those can lack, ``missed``.

    The ``rerank`` best by codes give the first exact scores; all whose score can reach those are scored next.
    """
    first = _best(approx, rerank)
    scores = np.sort(x[first].astype(float) @ q)
    if len(scores) >= most:
        least = max(least, scores[-most])
    rows = np.flatnonzero(~(approx + missed < least - rounding))
    scores = x[rows].astype(float) @ q
    if len(rows) > most:
        least = max(least, np.partition(scores, len(scores) - most)[len(scores) - most])
    return rows[~(scores < least - 2 * rounding)]


#: Rows found that a task holds before it combines them, and their columns.
MOST_HELD, _FOUND = 200_000, ["c1", "c2", "vec_id", "score", "own"]


def _firsts(held: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """Of rows (c1, c2, vec_id, score, own) the ``most`` best of each (c1, c2)."""
    c1, c2, vec_id, score, own = (np.concatenate([h[k] for h in held]) for k in range(5))
    order = np.lexsort((vec_id, -score, c2, c1))
    new = np.append(True, (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])) if len(order) else np.zeros(0, bool)
    at = np.arange(len(order))
    keep = order[at - np.maximum.accumulate(np.where(new, at, 0)) < most] if len(order) else order
    return c1[keep], c2[keep], vec_id[keep], score[keep], own[keep]


def search(index: Index, every: int = 20, most: int = 20, rerank: int = 160, at_once: int = 32) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``most`` largest inner products for each row whose id ``every`` divides. ``rerank`` says how many rows of a block are scored exactly before it is known which others have to be."""
    spark, dims, kind, book, coarse = index.classes.spark, index.dims, index.dtype, index.book, index.coarse
    if not index.count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if most > index.most:
        raise ValueError(f"the index holds what {index.most} neighbours take")
    asking = index.asking.read().where(F.col("id") % every == 0)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """To the blocks of the best parts, or, where it is known how good a row must be (a fourth column), to those others that can have one."""
        for b in small_batches(batches, 512):
            x = _matrix(b.column(2), dims)
            again = b.num_columns > 3
            least = b.column(3).to_numpy() if again else np.full(len(x), -np.inf)
            row, block = coarse.left(x, 8 * (most + 1), least) if again else coarse.probed(x, 8 * (most + 1))
            at = pa.array(row)
            names = np.stack([b.column(k).to_numpy() for k in (0, 1)], 1).astype("<i8")
            raw = [(n.tobytes(), v.tobytes(), f.tobytes()) for n, v, f in zip(names, x.astype(kind), least.astype("<f8"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), *(pa.array([r[k] for r in raw], pa.binary()).take(at) for k in (0, 1, 2))], ["block", "name", "query", "least"])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, offs in grouped(iter(batches), 1):
            for s, e in zip(offs[:-1], offs[1:], strict=True):
                for at in range(s, e, ASKED):
                    part = rows.slice(at, min(ASKED, e - at))
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), *(pa.array([b"".join(part.column(k).to_pylist())], pa.binary()) for k in (1, 2, 3))], ["block", "asked", "queries", "least"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of each query among all blocks that a task has, not of each block."""
        held, size = [], 0
        for found in meetings(batches):
            held.append(found)
            size += len(found[0])
            if size > MOST_HELD:
                held, size = [_firsts(held, most + 1)], 0
                size = len(held[0][0])
                if 2 * size > MOST_HELD:  # other queries than before
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], _FOUND)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _firsts(held, most + 1)], _FOUND)

    def meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in small_batches(batches, 1):
            asked, names = (np.frombuffer(b.column(k)[0].as_py(), "<i8").reshape(-1, 2) for k in (0, 3))
            q, x = (np.frombuffer(b.column(k)[0].as_py(), kind).reshape(-1, dims) for k in (1, 7))
            least, missed = (np.frombuffer(b.column(k)[0].as_py(), "<f8") for k in (2, 8))
            counts, ids = np.frombuffer(b.column(4)[0].as_py(), "<i4").astype(np.int64), np.frombuffer(b.column(5)[0].as_py(), "<i8")
            first = np.cumsum(counts) - counts
            longest = float(np.sqrt(np.square(x, dtype=float).sum(1).max(initial=0)))
            codes = np.ascontiguousarray(np.frombuffer(b.column(6)[0].as_py(), np.uint8).reshape(len(names), -1).T)
            for at in range(0, len(q), at_once):
                part, out = q[at : at + at_once].astype(float), []
                tables, scale, off = book.tables(part)
                approx = np.zeros((len(part), len(names)), np.float32)
                for m in range(len(codes)):
                    approx += np.take(tables[:, m], codes[m], axis=1)
                for i in range(len(part)):
                    length = float(np.linalg.norm(part[i]))
                    rows = _candidates(approx[i] * scale[i], length * missed * (1 + 1e-9) + off[i], x, part[i], most + 1, rerank, least[at + i], 4e-16 * (dims + 2) * length * longest)
                    exact = np.zeros(len(rows))
                    for d in range(dims):  # in order, so that equal vectors have equal scores
                        exact += x[rows, d].astype(float) * part[i, d]
                    top = np.lexsort((ids[first[rows]], -exact))[: most + 1]
                    rows, exact, n = rows[top], exact[top], counts[rows[top]]
                    own = np.repeat((names[rows] == asked[at + i]).all(1), n)
                    found, score = ids[np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], np.repeat(exact, n)
                    top = np.lexsort((found, -score))[: most + 1]
                    out.append((np.repeat(asked[at + i : at + i + 1], len(top), 0), found[top], score[top], own[top]))
                name = np.concatenate([o[0] for o in out])
                yield name[:, 0], name[:, 1], *(np.concatenate([o[k] for o in out]) for k in (1, 2, 3))

    def found_by(asked: DataFrame) -> tuple[DataFrame, Staged]:
        """What the blocks find that ``asked`` (c1, c2, v and, the second time, the least score that counts) goes to; and a table that this reads."""
        sent = asked.mapInArrow(tidied(send), "block int, name binary, query binary, least binary")
        chunks = Staged(sent.repartition(spread(spark), "block").sortWithinPartitions("block").mapInArrow(tidied(gather), "block int, asked binary, queries binary, least binary"), "ann_asked")
        met = chunks.read().join(index.blocks.read(), "block").select("asked", "queries", "least", "names", "counts", "ids", "codes", "vectors", "missed")
        return met.mapInArrow(tidied(scan), "c1 long, c2 long, vec_id long, score double, own boolean"), chunks

    def firsts(found: DataFrame) -> Staged:
        order = Window.partitionBy("c1", "c2").orderBy(F.desc("score"), "vec_id")
        nth = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most + 1)
        return Staged(nth.groupBy("c1", "c2").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score", "own"))).alias("found")), "ann_found")

    classes = asking.select("c1", "c2").distinct().join(index.classes.read().select("c1", "c2", "v"), ["c1", "c2"])
    found, chunks = found_by(classes)
    top = firsts(found)
    chunks.drop()
    if coarse.probes < len(coarse.centres):
        before = top
        least = before.read().select("c1", "c2", F.get("found", F.lit(most))["score"].alias("least"))
        found, chunks = found_by(classes.join(least, ["c1", "c2"], "left").select("c1", "c2", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least")))
        top = firsts(before.read().select("c1", "c2", F.inline("found")).select("c1", "c2", "vec_id", "score", "own").unionByName(found))
        for t in (before, chunks):
            t.drop()
    others = F.slice(F.filter("found", lambda f: ~(f["own"] & (f["vec_id"] == F.col("id")))), 1, most)
    ranked = asking.join(top.read(), ["c1", "c2"]).select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "f"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))
