"""Exact top-k search by inner product, pruned by segment statistics from coarse to fine.

A vector's component x becomes the whole number floor(256 * x). Cut into segments of equal length L, with means m and
deviations s, two vectors are at least sqrt(sum of L * ((m - m')^2 + (s - s')^2)) apart; as the lengths are known too, that
says their inner product is at most the sum of L * (m * m' + s * s'). Every candidate is held against a query's fifth best
score so far by the bound of the coarsest segments, then of the finer ones, down to segments of two or three components; only what
survives all levels is scored exactly, in whole numbers, each query's most promising candidates first, so that the fifth best score
is high from the start.

The queries go out in passes of a bounded number of bytes, each over all rows; no more than one pass is held on the driver. A task keeps k rows per
query, and one shuffle of those finds each query's best. Tables of bounds have a bounded number of cells.

Defined cases: vectors null, or with null or non-finite components, and rows without id take no part; rows that bear the query's id are its
own and no candidates; otherwise repeated rows each count; among rows of one query id the least vector is the query;
vectors are compared with those of their own length only, of length 0 too; ties go to the smaller vec_id; scores beyond a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SCALE = 256
K = 5
EVERY = 50
SEGMENTS = (4, 16)
PASS_BYTES = 64 << 20
#: Whole-number sums below this are exact in a double.
EXACT = 2.0**52
#: Pairs of a query and a row whose bounds are held at once, and that are scored at once.
CELLS, PAIRS = 1 << 21, 1 << 17


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as whole numbers in doubles, of the rows that take part."""
    good = "embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(double(x)) < double('infinity'))"
    return vectors.where(good).select(F.col("vec_id").cast("long"), F.expr(f"transform(embedding, x -> CASE WHEN abs({scale} * double(x)) < {EXACT} THEN double(floor({scale} * double(x))) ELSE {scale} * double(x) END)").alias("v"))


def levels(n: int) -> list[int]:
    """Numbers of segments for vectors of n components, each level finer, the last before single components."""
    out = list(SEGMENTS)
    while out[-1] * 2 < n:
        out.append(out[-1] * 2)
    return [p for p in out if p < n]


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of the segments of each row, each times the root of the segment's length."""
    out = []
    for seg in np.array_split(x, parts, axis=1):
        out += [seg.mean(1) * seg.shape[1] ** 0.5, seg.std(1) * seg.shape[1] ** 0.5]
    return np.stack(out, 1)


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.q, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        self.scored = 0  # pairs scored exactly

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.scored += len(q)
        worth = scores >= self.floor[q]
        q, ids, scores = q[worth], ids[worth], scores[worth]
        q, ids, scores = (np.concatenate(x) for x in ((self.q, q), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores.astype(np.float64) if abs(scores).max(initial=0) < EXACT else ~scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.q, self.ids, self.scores = q[keep], ids[keep], scores[keep]
        kth = np.arange(len(self.q)) - np.searchsorted(self.q, self.q) == self.k - 1
        self.floor[self.q[kth]] = self.scores[kth]


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, as longs."""
    if abs(queries).max(initial=0) * abs(rows).max(initial=0) * max(1, rows.shape[-1]) < EXACT:
        return np.einsum("ij,ij->i", queries, rows).astype(np.int64)
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(x, y)), low), high) for x, y in zip(queries, rows)], np.int64)


def _compare(best: Best, ids: np.ndarray, queries: np.ndarray, stats: list[np.ndarray], new_ids: np.ndarray, rows: np.ndarray) -> None:
    """Takes into best what rows (with new_ids) bring to queries (with ids, and with stats of each level)."""
    slack = 1e-9 * np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :] + 1e-6
    bound = np.where(ids[:, None] != new_ids[None, :], np.inf, -np.inf)
    for parts, own in zip(levels(rows.shape[1]), stats):
        alive = (bound >= best.floor[:, None]) & (bound > -np.inf)
        if not alive.any():
            return
        bound = np.where(alive, own @ statistics(rows, parts).T + slack, -np.inf)
    order = np.argsort(-bound, axis=1, kind="stable")
    done, width = 0, best.k
    while done < len(rows):  # the most promising of each query first, until no bound reaches its floor
        c = order[:, done : done + width].ravel()
        q = np.repeat(np.arange(len(ids)), len(c) // len(ids))
        worth = (bound[q, c] >= best.floor[q]) & (bound[q, c] > -np.inf)
        if not worth.any():
            return
        q, c = q[worth], c[worth]
        for at in range(0, len(q), PAIRS):
            some = slice(at, at + PAIRS)
            best.add(q[some], new_ids[c[some]], _scores(queries[q[some]], rows[c[some]]))
        done, width = done + width, 2 * width


def search(vectors: DataFrame, is_query: object = None, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of vectors (vec_id, embedding)."""
    rows = whole_vectors(vectors)
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    out, waiting = None, None
    for part in _passes(queries):
        if waiting is not None:  # several passes: each is done and written before the next, so only one is held
            done = cut(_one_pass(rows, waiting, k))
            out = done if out is None else out.unionByName(done)
        waiting = part
    if waiting is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    last = _one_pass(rows, waiting, k)
    out = last if out is None else out.unionByName(last)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _passes(queries: DataFrame) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The queries by length of vector, so many bytes at a time."""
    held: dict[int, tuple[list, list]] = {}
    size = 0
    for row in queries.toLocalIterator(prefetchPartitions=False):
        v = np.array(row.v, np.float64)
        ids, vs = held.setdefault(len(v), ([], []))
        ids.append(row.vec_id)
        vs.append(v)
        size += v.nbytes + 16
        if size >= PASS_BYTES:
            yield [(np.array(i), np.stack(x)) for i, x in held.values()]
            held, size = {}, 0
    if held:
        yield [(np.array(i), np.stack(x)) for i, x in held.values()]


def _one_pass(rows: DataFrame, part: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(part)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {x.shape[1]: (ids, x, [statistics(x, p) for p in levels(x.shape[1])], Best(len(ids), k)) for ids, x in shared.value}
        for batch in batches:
            column = batch.column("v")
            lengths = np.diff(column.offsets.to_numpy())
            flat, begins = column.values.to_numpy(), column.offsets.to_numpy()[:-1]
            new_ids = batch.column("vec_id").to_numpy()
            for n in np.unique(lengths):
                if n not in groups:
                    continue
                ids, queries, stats, best = groups[n]
                at = np.flatnonzero(lengths == n)
                for some in np.array_split(at, -(-len(at) // max(1, min(CELLS // len(ids), len(at))))):
                    x = flat[begins[some][:, None] + np.arange(n)] if n else np.zeros((len(some), 0))
                    _compare(best, ids, queries, stats, new_ids[some], x)
        for ids, _, _, best in groups.values():
            yield pa.RecordBatch.from_arrays([pa.array(ids[best.q]), pa.array(best.ids), pa.array(best.scores)], names=["query_id", "vec_id", "score"])

    return rows.mapInArrow(each, "query_id long, vec_id long, score long")
