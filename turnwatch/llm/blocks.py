"""Rows packed into blocks, and every query block met with every item block."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_count(rows: int, size: int) -> int:
    return max(1, math.ceil(rows / size))


def block_of(id_col: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine, F.lit(False))


def meet(queries: DataFrame, items: DataFrame, query_blocks: int, item_blocks: int) -> DataFrame:
    """Packed query blocks (``qb``) beside packed item blocks (``ib``): one row per pair of blocks.
    A block is a few MB, and it is blocks that are copied, not rows."""
    left = queries.withColumn("ib", F.explode(F.sequence(F.lit(0), F.lit(item_blocks - 1))))
    right = items.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    return left.join(right.hint("shuffle_hash"), ["ib", "qb"])


def query_row(block: int, rows: int) -> list[int]:
    """A number for each row of a query block: rows that repeat an id are queries of their own."""
    return [block << 32 | i for i in range(rows)]


def best(partial: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The ``k`` first rows of each ``query_row`` by ``order``, with their rank from 1. Each query has at
    most ``k`` partial rows per item block."""
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    return partial.withColumn("rank", rank).filter(F.col("rank") <= k)
