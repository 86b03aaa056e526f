"""Exact top-k search by term-at-a-time accumulation (operator 4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.blocks import best, block_count, block_of, finite, meet, query_row
from turnwatch.llm.rows import arrow_batch, arrow_schema

#: Rows of a block of items and of a block of queries, and queries scored together.
ITEM_BLOCK, QUERY_BLOCK, TILE = 4096, 2048, 64


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``(id, terms, weights)``: component ``t`` of a vector becomes the weight floor(scale * x) of
    term ``t``; zero weights are left out. Vectors that are null or hold a null, NaN or infinite component are left out."""
    v = F.col(vector_col)
    scaled = F.transform(v, lambda x, i: F.struct(
        i.cast("int").alias("term"), F.floor(F.lit(float(scale)) * x.cast("double")).cast("long").alias("weight")))
    return (vectors.filter(finite(v) & F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.filter(scaled, lambda p: p["weight"] != 0).alias("p"))
            .select("id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights")))


def _pack(rows: DataFrame, blocks: int, key: str) -> DataFrame:
    """Postings of each block, ordered by term: ids, and for each posting its term, row and weight."""
    ddl = f"{key} int, {key}_ids binary, {key}_terms binary, {key}_rows binary, {key}_weights binary"
    schema = arrow_schema(ddl)

    def pack(group, table):
        # The same order whenever the block is packed.
        table = table.take(pa.array(sorted(range(len(table)), key=list(zip(*(table[c].to_pylist() for c in ("id", "terms", "weights")))).__getitem__)))
        terms = table["terms"].combine_chunks()
        n = np.asarray(terms.value_lengths())
        t = np.asarray(terms.flatten(), np.int32)
        w = np.asarray(table["weights"].combine_chunks().flatten(), np.int64)
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        order = np.lexsort((row, t))
        return pa.table({key: [group[0].as_py()], f"{key}_ids": [np.asarray(table["id"], np.int64).tobytes()],
                         f"{key}_terms": [t[order].tobytes()], f"{key}_rows": [row[order].tobytes()],
                         f"{key}_weights": [w[order].tobytes()]}, schema=schema)

    return rows.withColumn(key, block_of("id", blocks)).groupBy(key).applyInArrow(pack, ddl)


def _accumulate(terms, rows, weights, q_terms, q_rows, q_weights, items: int, first: int, count: int) -> np.ndarray:
    """Scores of queries ``first`` to ``first + count`` against all items of a block: term by term,
    each query's weight times the term's postings is added to the query's score array."""
    scores = np.zeros((count, items), np.int64)
    mine = (q_rows >= first) & (q_rows < first + count)
    q_terms, q_rows, q_weights = q_terms[mine], q_rows[mine] - first, q_weights[mine]
    for term in np.unique(q_terms):
        s, e = np.searchsorted(terms, [term, term + 1])
        if s == e:
            continue
        a, b = np.searchsorted(q_terms, [term, term + 1])
        added = q_weights[a:b, None] * weights[None, s:e]
        # A query or an item holds a term once, so no place is added to twice.
        if e - s == items and b - a == count:
            scores += added
        elif e - s == items:
            scores[q_rows[a:b]] += added
        else:
            scores[np.ix_(q_rows[a:b], rows[s:e])] += added
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties to smaller ids, without the query's own row."""
    allowed = np.flatnonzero(ids != own)
    if not len(allowed):
        return allowed
    have = scores[allowed]
    if len(allowed) > k:
        floor = np.partition(have, len(have) - k)[len(have) - k]
        allowed = allowed[have >= floor]
        have = scores[allowed]
    return allowed[np.lexsort((ids[allowed], -have))[:k]]


def topk_search(queries: DataFrame, items: DataFrame, k: int, item_block: int = ITEM_BLOCK,
                query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, item_id, score)``: the ``k`` items of highest integer inner product for
    each query, ties to the smaller id, never the query's own id. Both sides are rows of
    ``(id, terms, weights)`` with distinct terms; a missing term counts as zero, and so an empty row scores zero everywhere.

    Every query meets every item, block by block. Fewer than ``k`` items give fewer rows; an empty
    side gives none. Rows that repeat an id are items, and queries, of their own. Sums must fit a 64-bit integer."""
    items_n, queries_n = items.count(), queries.count()
    ib, qb = block_count(items_n, item_block), block_count(queries_n, query_block)
    ddl = "query_row long, query_id long, item_id long, score long"
    schema = arrow_schema(ddl)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                get = {c: np.frombuffer(r[c], np.int64 if c.endswith(("ids", "weights")) else np.int32)
                       for c in r if c not in ("ib", "qb")}
                ids, own = get["ib_ids"], get["qb_ids"]
                for first in range(0, len(own), TILE):
                    count = min(TILE, len(own) - first)
                    scores = _accumulate(get["ib_terms"], get["ib_rows"], get["ib_weights"], get["qb_terms"],
                                         get["qb_rows"], get["qb_weights"], len(ids), first, count)
                    q, i, s, rows = [], [], [], []
                    numbers = query_row(r["qb"], len(own))
                    for j in range(count):
                        pick = select(scores[j], ids, own[first + j], k)
                        q += [own[first + j]] * len(pick)
                        rows += [numbers[first + j]] * len(pick)
                        i.append(ids[pick])
                        s.append(scores[j][pick])
                    yield arrow_batch({"query_row": rows, "query_id": q, "item_id": np.concatenate(i), "score": np.concatenate(s)}, schema)

    pairs = meet(_pack(queries, qb, "qb"), _pack(items, ib, "ib"), qb, ib)
    partial = pairs.mapInArrow(run, ddl)
    return best(partial, k, [F.desc("score"), F.asc("item_id")]).select("query_id", "rank", "item_id", "score")
