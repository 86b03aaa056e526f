"""Connected components of a link table, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwatch.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def stars(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(u, v)``, u > v, with the same connected nodes and shorter ways: after enough rounds each node
    is linked to the smallest of its component only, which ends the loop; ``rounds`` ends it earlier.

    A round first joins every larger neighbour to the smallest one around a node, then every node and its smaller
    neighbours."""
    edges = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .filter("u > v").distinct())
    state, done = _state(edges) if rounds is None else None, 0
    while done != rounds and state != (0, None):
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        # Every row of ``large`` points downwards, so the smaller neighbours of u are its v.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.toDF("u", "v"))).filter("u > v").distinct()
        edges = cut_lineage(small)
        done += 1
        if rounds is None:
            before, state = state, _state(edges)
            if state == before:
                break
    return edges


def components(edges: DataFrame) -> DataFrame:
    """``(doc, component)`` for every end of ``(u, v)``: the smallest end that links reach."""
    edges = stars(edges)
    return edges.toDF("doc", "component").union(edges.select("v", "v")).distinct()
