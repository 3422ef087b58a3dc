"""Operator 9: exact top-k inner products by dual-tree search over cover trees.

The queries (a stated, bounded set at a time) are indexed in one cover tree, each block of data rows
in another. Pairs of nodes are visited together; a pair is skipped when even the best inner product
that the covering radii allow is below the worst kth score of the node's queries so far.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import make
from .scratch import Scratch

#: Queries sent with the tasks at once (64 dimensions: 4 MB); more are answered in further passes.
QUERY_ROWS = 8192
#: Data rows indexed together in a task.
BLOCK_ROWS = 4096
LEAF_ROWS = 32


class CoverTree:
    """A cover tree over the rows of `points`.

    A node holds a centre, the radius that covers all rows below it, and either rows (leaf) or child
    nodes. The centres of a node's children lie farther apart than half its radius (separation) and
    every row is within half the radius of its child's centre (covering); the first child keeps the
    centre (nesting). Children too small to split further share one leaf around the parent's centre.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[np.ndarray] = []
        self.norm: list[float] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray] = []
        self.children: list[list[int]] = []
        if len(points):
            self._build(np.arange(len(points)), points[0])

    def _add(self, rows: np.ndarray, centre: np.ndarray) -> int:
        far = self.points[rows] - centre
        self.centre.append(centre)
        self.norm.append(float(np.sqrt(centre @ centre)))
        self.radius.append(float(np.sqrt(np.einsum("ij,ij->i", far, far).max())))
        self.rows.append(rows)
        self.children.append([])
        return len(self.rows) - 1

    def _build(self, rows: np.ndarray, centre: np.ndarray) -> None:
        todo = [self._add(rows, centre)]
        while todo:
            node = todo.pop()
            rows, half = self.rows[node], self.radius[node] / 2
            if len(rows) <= LEAF_ROWS or not half:
                continue
            left, points, c, few = rows, self.points[rows], self.centre[node], []
            while len(left):
                away = points - c
                near = np.einsum("ij,ij->i", away, away) <= half * half
                group = left[near]
                if len(group) > LEAF_ROWS:
                    child = self._add(group, c)
                    self.children[node].append(child)
                    todo.append(child)
                elif len(group):
                    few.append(group)
                left, points = left[~near], points[~near]
                if len(left):
                    c = points[0]
            if few:
                self.children[node].append(self._add(np.concatenate(few), self.centre[node]))


class Best:
    """The k best (score, id) of each query so far; ties to smaller ids; an id counts once."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.top: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.kth = np.full(len(ids), -np.inf)

    def offer(self, queries: np.ndarray, scores: np.ndarray, members: list[np.ndarray]) -> None:
        """scores: queries x distinct vectors; members: the smallest ids of each vector."""
        open_ = scores >= self.kth[queries, None]
        for r in np.flatnonzero(open_.any(1)):
            q, row = queries[r], scores[r]
            at = np.flatnonzero(open_[r])
            if len(at) > 2 * self.k:
                least = np.partition(row[at], -self.k - 1)[-self.k - 1]
                at = at[row[at] >= least]
            own = int(self.ids[q])
            found = {(-float(row[j]), int(i)) for j in at for i in members[j] if int(i) != own}
            self.top[q] = heapq.nsmallest(self.k, found.union(self.top[q]))
            if len(self.top[q]) == self.k:
                self.kth[q] = -self.top[q][-1][0]


def dual_search(queries: CoverTree, best: Best, data: CoverTree, members: list[np.ndarray]) -> int:
    """Offers all data rows that may matter to the queries; returns the number of scores computed."""
    if not len(queries.points) or not len(data.points):
        return 0

    def bound(a: int, b: int) -> float:
        most = queries.centre[a] @ data.centre[b] + queries.norm[a] * data.radius[b] + data.norm[b] * queries.radius[a] + queries.radius[a] * data.radius[b]
        return float(most) + 1e-9 * abs(float(most)) + 1e-6

    work, todo = 0, [(bound(0, 0), 0, 0)]
    while todo:
        most, a, b = todo.pop()
        if most < best.kth[queries.rows[a]].min():
            continue
        inner_a, inner_b = queries.children[a], data.children[b]
        if inner_a and (not inner_b or queries.radius[a] >= data.radius[b]):
            todo += sorted((bound(x, b), x, b) for x in inner_a)
        elif inner_b:
            todo += sorted((bound(a, x), a, x) for x in inner_b)
        else:
            rows, cols = queries.rows[a], data.rows[b]
            scores = queries.points[rows] @ data.points[cols].T
            work += scores.size
            best.offer(rows, scores, [members[c] for c in cols])
    return work


def whole_vectors(ids: pa.Array, vectors: pa.Array, factor: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids and floor(factor * x) of the rows that take part."""
    keep = np.ones(len(ids), bool)
    keep &= ids.is_valid().to_numpy(zero_copy_only=False)
    keep &= vectors.is_valid().to_numpy(zero_copy_only=False)
    ids, vectors = ids.filter(pa.array(keep)), vectors.filter(pa.array(keep))
    flat = vectors.flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # nulls become NaN
    offsets = np.concatenate(([0], np.cumsum(np.diff(vectors.offsets.to_numpy()))))
    lengths, names = np.diff(offsets), ids.to_numpy(zero_copy_only=False)
    out = {}
    for n in set(lengths.tolist()):
        at = np.flatnonzero(lengths == n)
        block = values[offsets[at][:, None] + np.arange(n)]
        good = np.isfinite(block).all(1)
        out[n] = (names[at][good], np.floor(factor * block[good]))
    return out


def distinct(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, each with its k+1 smallest ids: no more can reach a top k, so hot vectors cost no more than rare ones."""
    if not points.shape[1]:  # vectors without components: all scores are 0
        return points[:1], [np.unique(ids)[: k + 1]]
    view = np.ascontiguousarray(points).view([("", points.dtype)] * points.shape[1]).ravel()
    _, first, back = np.unique(view, return_index=True, return_inverse=True)
    order = np.lexsort((ids, back))
    cuts = np.flatnonzero(np.diff(back[order])) + 1
    return points[first], [np.unique(g)[: k + 1] for g in np.split(ids[order], cuts)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", factor: float = 256.0, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Each query's k highest inner products of floor(factor * x): query_id, rank, key, score.

    Ties go to the smaller id; a row is never its own neighbour; exact repeats of a row count once.
    Rows with a null id, and vectors that are null or hold a null or non-finite component, take no
    part; vectors of different lengths have no score together, those without components score 0. Fewer than k candidates give
    fewer rows; an empty table gives none.

    At most about `query_rows` queries are collected at a time and sent along; every pass reads the
    table once and hands on k rows per query and task. With several passes each is written and its
    queries are freed before the next.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("bigint").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    asked = vectors.where(is_query).select(F.col(key).cast("bigint").alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    passes = max(1, -(-asked.count() // query_rows))
    part, scratch = None, Scratch(spark, "topk")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("_id")))
        return found.dropDuplicates(["query_id", "_id", "score"]).withColumn("rank", rank).where(F.col("rank") <= k)

    for p in range(passes):
        held = [(r["_id"], r["_v"]) for r in asked.where(F.pmod(F.xxhash64("_id"), F.lit(passes)) == p).toLocalIterator()]
        sent = spark.sparkContext.broadcast(whole_vectors(pa.array([i for i, _ in held], pa.int64()), pa.array([v for _, v in held], pa.list_(pa.float64())), factor))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            trees = {n: (CoverTree(points), Best(ids, k)) for n, (ids, points) in sent.value.items()}
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK_ROWS):
                    piece = batch.slice(lo, BLOCK_ROWS)
                    for n, (ids, points) in whole_vectors(piece.column(0), piece.column(1), factor).items():
                        if n in trees and len(ids):
                            own, members = distinct(ids, points, k)
                            dual_search(*trees[n], CoverTree(own), members)
            schema = pa.schema([("query_id", pa.int64()), ("_id", pa.int64()), ("score", pa.int64())])
            for _, best in trees.values():
                found = [(int(q), i, int(-s)) for q, top in zip(best.ids, best.top, strict=True) for s, i in top]
                if found:
                    yield make(schema, *map(list, zip(*found, strict=True)))

        own = rows.mapInArrow(run, "query_id bigint, _id bigint, score bigint")
        if passes > 1:  # answered, written and freed before the next queries are collected
            own = scratch.write(ranked(own))
            sent.destroy()
        part = own if part is None else part.unionByName(own)
    out = part if passes > 1 else ranked(part)
    return out.select("query_id", "rank", F.col("_id").alias(key), "score")


def query(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
           FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""
