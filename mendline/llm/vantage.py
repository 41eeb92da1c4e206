"""Nearest neighbours with a vantage-point tree per shard of vectors.

Each task turns its vectors into shards of at most ``SHARD`` rows. A tree node has a vantage
point and the median distance of the others to it; nearer ones go inside, the rest outside.
A search goes down for many queries at once: at a node each query first enters the side it lies on, then
the other side unless the triangle inequality rules it out, that is unless

    factor * |distance to the vantage point - median| > distance to the k-th neighbour so far.

``factor`` 1 is exact; a larger one skips more and may lose neighbours. What earlier shards of a task have found
prunes later ones. Only the best ``k`` per query and task are shuffled.

Queries are a stated set of rows, taken in blocks of at most ``QUERY_BLOCK`` vectors; each block is
broadcast and searched in a pass of its own, so its size has a fixed bound.

Distances are Euclidean in double precision on the original vectors; ties go to the smaller id. Vectors that
are NULL, empty, zero, or hold NULL or non-finite components take no part, nor do rows without id; vectors of another length than the query's are no
candidates. Of repeated query rows one counts; repeated candidate rows are candidates each. Equal vectors end in one leaf,
which is searched in pieces of ``PAIRS`` pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

SHARD = 20_000
LEAF = 128
QUERY_BLOCK = 20_000
#: Levels of a tree; where distances are so tied that halving fails, what is left then is one leaf.
MOST_DEPTH = 48
#: Numbers, and pairs of a query and a candidate, that are held at once.
NUMBERS = 1 << 18
PAIRS = 1 << 20
_OUT = "query_id bigint, vec_id bigint, score double"


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest other rows of every query row."""
    x = F.col(vector)
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    sound = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, fine) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(sound).select(F.col(key).cast("bigint").alias("id"), x.cast("array<double>").alias("x"))
    asked = rows.where(F.coalesce(is_query, F.lit(False)))
    spark, parts, block = vectors.sparkSession, [], {}

    def searched() -> DataFrame:
        shared = spark.sparkContext.broadcast(_stacked(block))
        found = rows.mapInArrow(partial(_search, queries=shared, k=k, factor=factor), _OUT)
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    for row in asked.toLocalIterator():
        block.setdefault(row["id"], row["x"])
        if len(block) >= QUERY_BLOCK:
            parts.append(stored(searched(), "nearest"))
            block = {}
    if block or not parts:
        parts.append(searched())
    return reduce(DataFrame.unionAll, parts).select("query_id", "rank", "vec_id", "score")


def _stacked(block: dict[int, list[float]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Queries by length of their vectors: ids and vectors."""
    out = {}
    for size in {len(x) for x in block.values()}:
        own = sorted((i, x) for i, x in block.items() if len(x) == size)
        out[size] = np.array([i for i, _ in own], dtype=np.int64), np.array([x for _, x in own], dtype=float)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of ``a`` to every row of ``b``, by the definition."""
    out = np.empty((len(a), len(b)))
    most = max(1, NUMBERS // a.shape[1])
    wide = max(1, min(len(b), most))
    high = max(1, most // wide)
    for i in range(0, len(a), high):
        for j in range(0, len(b), wide):
            step = a[i : i + high, None, :] - b[None, j : j + wide, :]
            out[i : i + high, j : j + wide] = np.sqrt(np.square(step, out=step).sum(2))
    return out


class Tree:
    """A vantage-point tree over the rows of an array."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray, depth: int = 0):
        if len(rows) <= LEAF or depth == MOST_DEPTH:
            return rows
        vantage, others = rows[:1], rows[1:]
        away = distances(self.vectors[vantage], self.vectors[others])[0]
        middle = np.median(away)
        inside = away < middle
        if not inside.any():  # half of them or more are as near as the nearest
            inside = away <= middle
            if inside.all():
                return rows
        parts = (self._build(others[side], depth + 1) for side in (inside, ~inside))
        return vantage, middle, *parts, away[inside].max(), away[~inside].min()


class Best:
    """The best ``k`` candidates so far of every query."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.query, self.vectors, self.k = ids, vectors, k
        self.away = np.full((len(ids), k), np.inf)
        self.ids = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, own: np.ndarray, ids: np.ndarray, away: np.ndarray) -> None:
        """Candidates for the queries ``own``, with their distances."""
        away = np.where(ids[None, :] == self.query[own][:, None], np.inf, away)
        near = (away <= self.away[own, -1:]).any(1)
        own, away = own[near], away[near]
        if not len(own):
            return
        all_away = np.concatenate([self.away[own], away], axis=1)
        all_ids = np.concatenate([self.ids[own], np.broadcast_to(ids, away.shape)], axis=1)
        all_ids = np.where(np.isinf(all_away), np.iinfo(np.int64).max, all_ids)
        order = np.lexsort((all_ids, all_away), axis=-1)[:, : self.k]
        self.away[own] = np.take_along_axis(all_away, order, axis=1)
        self.ids[own] = np.take_along_axis(all_ids, order, axis=1)

    def search(self, tree: Tree, factor: float) -> None:
        self._visit(tree, tree.root, np.arange(len(self.query)), factor)

    def _visit(self, tree: Tree, node, own: np.ndarray, factor: float) -> None:
        if not len(own):
            return
        if isinstance(node, np.ndarray):
            step = max(1, PAIRS // len(node))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                self.offer(some, tree.ids[node], distances(self.vectors[some], tree.vectors[node]))
            return
        vantage, middle, inside, outside, inner_most, outer_least = node
        away = distances(self.vectors[own], tree.vectors[vantage])
        self.offer(own, tree.ids[vantage], away)
        away = away[:, 0]
        first = away < middle
        self._visit(tree, inside, own[first], factor)
        self._visit(tree, outside, own[~first], factor)
        rounding = 1 - 1e-9  # bounds are computed, so they are held against a little more
        self._visit(tree, outside, own[first][self._may(own[first], (outer_least - away[first]) * factor * rounding)], factor)
        self._visit(tree, inside, own[~first][self._may(own[~first], (away[~first] - inner_most) * factor * rounding)], factor)

    def _may(self, own: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return bound <= self.away[own, -1]


def _search(rows: Iterator[pa.RecordBatch], queries, k: int, factor: float) -> Iterator[pa.RecordBatch]:
    best = {size: Best(ids, vectors, k) for size, (ids, vectors) in queries.value.items()}
    held: dict[int, list] = {size: [] for size in best}

    def flush(size: int) -> None:
        if held[size]:
            ids, vectors = (np.concatenate([x[i] for x in held[size]]) for i in (0, 1))
            best[size].search(Tree(ids, vectors), factor)
            held[size] = []

    for part in rows:
        x = part.column("x")
        lengths = np.diff(x.offsets.to_numpy())
        flat, starts = x.values.to_numpy(), x.offsets.to_numpy()[:-1]
        ids = part.column("id").to_numpy()
        for size in held:
            own = np.flatnonzero(lengths == size)
            for at in range(0, len(own), SHARD):
                some = own[at : at + SHARD]
                held[size].append((ids[some], flat[starts[some][:, None] + np.arange(size)]))
                if sum(len(i) for i, _ in held[size]) >= SHARD:
                    flush(size)
    for size, found in best.items():
        flush(size)
        query, rank = np.nonzero(np.isfinite(found.away))
        for at in range(0, len(query), 50_000):
            q, r = query[at : at + 50_000], rank[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.query[q]), pa.array(found.ids[q, r]), pa.array(found.away[q, r])], names=["query_id", "vec_id", "score"]
            )
