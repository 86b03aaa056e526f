"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from turnwatch.session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark, Path(__file__).resolve().parent)
            return fn(spark, folder)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents, spread over the cores where they come as one small file."""
    return spread(table(spark, folder, "documents"))
