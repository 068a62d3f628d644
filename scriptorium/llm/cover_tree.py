"""Exact top-k inner products by a dual-tree search over cover trees.

Rows are dealt into shards of about ``SHARD_ROWS`` vectors and queries into blocks of about
``BLOCK_QUERIES``; each gets a cover tree, kept as one binary row. A block meets each shard
once: the pair of trees is searched together, and a pair of nodes is left out where the
largest product its covering radii allow is below the worst kth score of its queries.
Blocks are replicated to the shards' tasks and read one at a time, so a task holds one
shard and one block. The shards' best k are merged by a ranking window per query.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.runtime import cut_lineage

SCALE = 256
TOP = 5
QUERY_EVERY = 50
SHARD_ROWS = 4096
BLOCK_QUERIES = 1024
LEAF_ROWS = 64
SHRINK = 1.5  # a level's covering radius over the next one's
_DOUBLE_SAFE = 2.0**52  # inner products below it are exact in doubles
_LONG_SAFE = 2.0**62  # and below it in longs; beyond, Python's integers are used


class CoverTree:
    """Nodes over integer vectors; node i covers rows[first[i]:last[i]] within radius[i] of its centre."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf_rows: int = LEAF_ROWS, names: np.ndarray | None = None) -> None:
        points = vectors.astype(np.float64)
        self.centers, self.radius, self.first, self.last, self.kids = [], [], [], [], []
        order: list[np.ndarray] = []
        self._at = 0
        self._build(points, np.arange(len(ids)), 0 if len(ids) else None, leaf_rows, order)
        rows = np.concatenate(order) if order else np.zeros(0, np.int64)
        self.ids, self.points = ids[rows], vectors[rows]
        self.rows = (ids if names is None else names)[rows]  # what tells rows of one id apart
        self.centers = points[self.centers] if len(ids) else points
        self.norms = np.sqrt((self.centers**2).sum(axis=1))
        self.radius = np.array(self.radius)
        del self._at

    def _build(self, points: np.ndarray, own: np.ndarray, center: int | None, leaf_rows: int, order: list[np.ndarray]) -> None:
        """Depth first without recursion: (rows, centre, parent) are taken from a stack."""
        if center is None:
            return
        stack = [(own, center, -1)]
        while stack:
            own, center, parent = stack.pop()
            node = len(self.radius)
            if parent >= 0:
                self.kids[parent].append(node)
            gap = np.sqrt(((points[own] - points[center]) ** 2).sum(axis=1))
            radius = float(gap.max())
            self.centers.append(center)
            self.radius.append(radius)
            self.kids.append([])
            self.first.append(self._at)
            self.last.append(self._at + len(own))
            if len(own) <= leaf_rows or radius == 0:
                order.append(own)
                self._at += len(own)
                continue
            cover, left, parts = radius / SHRINK, own, []
            pivot = center
            while len(left):  # greedy net: centres are over ``cover`` apart
                away = np.sqrt(((points[left] - points[pivot]) ** 2).sum(axis=1))
                inside = away <= cover
                parts.append((left[inside], pivot, node))
                left, away = left[~inside], away[~inside]
                if len(left):
                    pivot = int(left[away.argmax()])
            small = [p for p in parts if len(p[0]) < 4]
            if len(small) > 1:  # stray points share one leaf-like child around the node's centre
                parts = [p for p in parts if len(p[0]) >= 4]
                stray = np.concatenate([p[0] for p in small])
                for at in range(0, len(stray), leaf_rows):
                    parts.append((stray[at : at + leaf_rows], int(stray[at]), node))
            stack.extend(reversed(parts))


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int, kind: type = np.float64) -> None:
        self.scores = np.zeros((n, k), kind)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)
        self.real = np.zeros((n, k), bool)  # places that hold a row
        self.least = np.full(n, -np.inf)  # about the kth score, never above it

    def offer(self, rows: slice, ids: np.ndarray, scores: np.ndarray, other: np.ndarray) -> None:
        """``other`` marks the pairs that count: not a query with its own row."""
        k = self.scores.shape[1]
        useful = (other & (~self.real[rows, -1:] | (scores >= self.scores[rows, -1:]))).any(axis=0)
        if not useful.any():
            return
        scores, ids, other = scores[:, useful], ids[useful], other[:, useful]
        all_scores = np.concatenate((self.scores[rows], scores), axis=1)
        all_ids = np.concatenate((self.ids[rows], np.broadcast_to(ids, scores.shape)), axis=1)
        all_real = np.concatenate((self.real[rows], other), axis=1)
        best = _order(all_scores, all_ids, all_real)[:, :k]
        self.scores[rows] = np.take_along_axis(all_scores, best, axis=1)
        self.ids[rows] = np.take_along_axis(all_ids, best, axis=1)
        self.real[rows] = np.take_along_axis(all_real, best, axis=1)
        low = self.scores[rows, -1].astype(np.float64)
        self.least[rows] = np.where(self.real[rows, -1], low - 1e-9 * np.abs(low), -np.inf)


def _order(scores: np.ndarray, ids: np.ndarray, real: np.ndarray) -> np.ndarray:
    """Places of each row by score descending, then id; what is not real comes last."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores, ~real), axis=1)
    key = lambda row: sorted(range(len(row[0])), key=lambda j: (not row[2][j], -row[0][j], row[1][j]))
    return np.array([key(row) for row in zip(scores, ids, real)])


def dual_search(queries: CoverTree, data: CoverTree, k: int) -> Best:
    """Best k of ``data`` for each query, the query's own row left out."""
    if not len(queries.ids) or not len(data.ids):
        return Best(len(queries.ids), k)
    largest = float(max(np.abs(queries.points).max(initial=0), np.abs(data.points).max(initial=0))) ** 2 * max(1, data.points.shape[1])
    exact = np.float64 if largest < _DOUBLE_SAFE else np.int64 if largest < _LONG_SAFE else object
    best = Best(len(queries.ids), k, exact)
    q_points, d_points = queries.points.astype(exact), data.points.astype(exact)

    def bound(q: int, ds: np.ndarray) -> np.ndarray:
        a, r = queries.norms[q], queries.radius[q]
        top = data.centers[ds] @ queries.centers[q] + r * data.norms[ds] + data.radius[ds] * (a + r)
        return top + 1e-9 * (1 + np.abs(top))

    stack = [(0, 0, float(bound(0, np.array([0]))[0]))]
    while stack:
        q, d, top = stack.pop()
        rows = slice(queries.first[q], queries.last[q])
        if top < best.least[rows].min():
            continue
        q_kids, d_kids = queries.kids[q], data.kids[d]
        if not q_kids and not d_kids:
            span = slice(data.first[d], data.last[d])
            scores = q_points[rows] @ d_points[span].T
            best.offer(rows, data.ids[span], scores, queries.rows[rows][:, None] != data.rows[span][None, :])
        elif d_kids and (not q_kids or data.radius[d] >= queries.radius[q]):
            kids = np.array(d_kids)
            tops = bound(q, kids)
            stack.extend((q, int(kids[i]), float(tops[i])) for i in np.argsort(tops, kind="stable"))
        else:
            one = np.array([d])
            stack.extend((child, d, float(bound(child, one)[0])) for child in q_kids)
    return best


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v, row)`` with v = floor(scale * component); ``row`` tells rows apart.

    Rows with a null id, a null vector or a null or non-finite component are left out.
    Repeated rows all stay.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(finite)
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return own.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row"))


def _trees(rows: DataFrame, name: str, groups: int) -> DataFrame:
    """One row a (dim, group): the pickled tree of its vectors."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["vec_id"].to_numpy(np.int64)
        vectors = np.array(frame["v"].tolist(), np.int64).reshape(len(ids), -1)
        tree = pickle.dumps(CoverTree(ids, vectors, names=frame["row"].to_numpy(np.int64)), protocol=pickle.HIGHEST_PROTOCOL)
        return pd.DataFrame({"dim": [int(frame["dim"].iloc[0])], name: [int(frame[name].iloc[0])], "tree": [tree]})

    dealt = rows.select("vec_id", "v", "row", F.size("v").alias("dim"), F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias(name))
    return dealt.groupBy("dim", name).applyInPandas(build, f"dim int, {name} int, tree binary")


def top_k(vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(query_id, query_row, rank, vec_id, score)``: each query's k best rows (all, if there are fewer).

    Queries are rows whose vec_id is divisible by ``every``; vectors meet vectors of their
    own dimension. Rows that repeat an id are candidates of each other and queries of their
    own: k rows are returned for each, which ``query_row`` tells apart. Scores are exact
    for products of any size that a long holds. An empty table gives an empty result.
    """
    rows = cut_lineage(quantised(vectors))
    asked = rows.where(F.col("vec_id") % every == 0)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    blocks = max(1, math.ceil(asked.count() / block_queries))
    index = _trees(rows, "shard", shards)
    groups = _trees(asked, "block", blocks).withColumnRenamed("tree", "queries")
    groups = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = index.hint("merge").join(groups.hint("merge"), ["dim", "shard"]).select("queries", "tree")  # sizes before the trees would have a block for each shard broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, d in zip(batch.column(0), batch.column(1)):
                queries = pickle.loads(q.as_py())
                best = dual_search(queries, pickle.loads(d.as_py()), k)
                asked_ids, asked_rows = (np.broadcast_to(x[:, None], best.real.shape)[best.real] for x in (queries.ids, queries.rows))
                columns = [asked_ids, asked_rows, best.ids[best.real], best.scores[best.real].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "query_row", "vec_id", "score"])

    near = pairs.mapInArrow(run, "query_id long, query_row long, vec_id long, score long")
    order = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")
