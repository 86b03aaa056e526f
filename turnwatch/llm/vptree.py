"""Approximate nearest neighbours by vantage-point trees, one per shard (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.blocks import best, block_count, block_of, finite, meet, query_row
from turnwatch.llm.rows import arrow_batch, arrow_schema

SHARD, QUERY_BLOCK, LEAF = 8192, 2048, 64
#: A side of a vantage point is passed over when it lies further away than the tenth best distance
#: divided by this factor. 1 gives exact results.
FACTOR = 1.15


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, dim, vec)`` in double precision, without vectors that are null, zero, empty or hold a
    null, NaN or infinite component."""
    v: Column = F.col(vector_col)
    return (vectors.filter(finite(v) & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dim"), v.cast("array<double>").alias("vec")))


class Tree:
    """Points in tree order. A node is a range of them: its first point is the vantage point, the
    nearer half of the others follows, then the farther half; small ranges are leaves."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, radius: np.ndarray):
        self.points, self.ids, self.radius = points, ids, radius

    @staticmethod
    def build(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> "Tree":
        order = np.argsort(ids, kind="stable")
        radius = np.zeros(len(ids))
        todo = [(0, len(ids))]
        while todo:
            s, e = todo.pop()
            if e - s <= leaf:
                continue
            # The vantage point: the one farthest from the range's first point, near the rim of the set.
            here = order[s:e]
            v = int(np.argmax(distances(points[here[:1]], points[here])[0]))
            order[s], order[s + v] = order[s + v], order[s]
            rest = order[s + 1:e]
            d = distances(points[order[s:s + 1]], points[rest])[0]
            half = len(rest) // 2
            by = np.argpartition(d, half)
            order[s + 1:e] = rest[by]
            radius[s] = d[by[half]]
            todo += [(s + 1, s + 1 + half), (s + 1 + half, e)]
        return Tree(points[order], ids[order], radius)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float, leaf: int = LEAF):
        """Ids and distances of the ``k`` nearest points found for each query; ties to smaller ids."""
        found_d = np.full((len(queries), k), np.inf)
        found_i = np.full((len(queries), k), np.iinfo(np.int64).max)

        def offer(q: np.ndarray, s: int, e: int, d: np.ndarray) -> None:
            d = np.where(self.ids[None, s:e] == own[q][:, None], np.inf, d)
            hit = np.flatnonzero(d.min(axis=1) <= found_d[q, -1])
            if not len(hit):
                return
            at = q[hit]
            every_d = np.concatenate([found_d[at], d[hit]], axis=1)
            every_i = np.concatenate([found_i[at], np.broadcast_to(self.ids[s:e], (len(hit), e - s))], axis=1)
            every_i = np.where(np.isinf(every_d), np.iinfo(np.int64).max, every_i)
            order = np.lexsort((every_i, every_d), axis=1)[:, :k]
            found_d[at] = np.take_along_axis(every_d, order, axis=1)
            found_i[at] = np.take_along_axis(every_i, order, axis=1)

        def visit(s: int, e: int, q: np.ndarray) -> None:
            if not len(q) or s >= e:
                return
            if e - s <= leaf:
                offer(q, s, e, distances(queries[q], self.points[s:e]))
                return
            d = distances(queries[q], self.points[s:s + 1])
            offer(q, s, s + 1, d)
            d = d[:, 0]
            half = s + 1 + (e - s - 1) // 2
            r, near = self.radius[s], d < self.radius[s]
            visit(s + 1, half, q[near])
            visit(half, e, q[~near])
            reach = found_d[q, -1] / factor
            visit(half, e, q[near & (d + reach >= r)])
            visit(s + 1, half, q[~near & (d - reach <= r)])

        visit(0, len(self.ids), np.arange(len(queries)))
        return found_i, found_d


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences themselves."""
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):
        diff = a[i:i + 64, None, :] - b[None]
        out[i:i + 64] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.asarray(table["id"], np.int64)
    points = np.asarray(table["vec"].combine_chunks().flatten(), float).reshape(len(ids), -1)
    # The same order whenever a block is built.
    order = sorted(range(len(ids)), key=lambda i: (ids[i], points[i].tobytes()))
    return ids[order], points[order]


def nearest(queries: DataFrame, items: DataFrame, k: int, factor: float = FACTOR, shard: int = SHARD,
            query_block: int = QUERY_BLOCK, leaf: int = LEAF) -> DataFrame:
    """``(query_id, rank, item_id, score)``: the ``k`` nearest items found for each query, nearest
    first, ties to the smaller id, never the query's own id; ``score`` is the Euclidean distance.

    Both sides are rows of ``(id, dim, vec)`` from ``usable``; vectors of other lengths than the query's
    are no candidates. Each shard of items is a tree, built once as a row of its own; every query
    block searches every tree. Fewer items give fewer rows; an empty side gives none. Rows that
    repeat an id are items, and queries, of their own."""
    if factor < 1:
        raise ValueError("factor below 1")
    ib, qb = block_count(items.count(), shard), block_count(queries.count(), query_block)
    tree_ddl = "ib int, dim int, ids binary, points binary, radius binary"
    tree_schema = arrow_schema(tree_ddl)
    block_ddl = "qb int, q_dim int, q_ids binary, q_points binary"
    block_schema = arrow_schema(block_ddl)

    def build(key, table):
        ids, points = _matrix(table)
        tree = Tree.build(points, ids, leaf)
        return pa.table({"ib": [key[0].as_py()], "dim": [key[1].as_py()], "ids": [tree.ids.tobytes()],
                         "points": [tree.points.tobytes()], "radius": [tree.radius.tobytes()]}, schema=tree_schema)

    def pack(key, table):
        ids, points = _matrix(table)
        return pa.table({"qb": [key[0].as_py()], "q_dim": [key[1].as_py()], "q_ids": [ids.tobytes()],
                         "q_points": [points.tobytes()]}, schema=block_schema)

    trees = items.withColumn("ib", block_of("id", ib)).groupBy("ib", "dim").applyInArrow(build, tree_ddl)
    blocks = queries.withColumn("qb", block_of("id", qb)).groupBy("qb", "dim").applyInArrow(pack, block_ddl)
    ddl = "query_row long, query_id long, item_id long, score double"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                tree = Tree(np.frombuffer(r["points"]).reshape(-1, dim), np.frombuffer(r["ids"], np.int64),
                            np.frombuffer(r["radius"]))
                own = np.frombuffer(r["q_ids"], np.int64)
                i, d = tree.search(np.frombuffer(r["q_points"]).reshape(-1, dim), own, k, factor, leaf)
                real = np.isfinite(d)
                rows = np.array(query_row(r["qb"], len(own)), np.int64)
                yield arrow_batch({"query_row": np.broadcast_to(rows[:, None], i.shape)[real],
                                   "query_id": np.broadcast_to(own[:, None], i.shape)[real], "item_id": i[real],
                                   "score": d[real]}, schema)

    pairs = meet(blocks, trees, qb, ib).filter("dim = q_dim")
    return best(pairs.mapInArrow(run, ddl), k, [F.asc("score"), F.asc("item_id")]).select(
        "query_id", "rank", "item_id", "score")
