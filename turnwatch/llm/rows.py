"""Small helpers shared by the operators: Arrow rows and the read of a table."""

from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnwatch.session import new_folder

_TYPES = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "smallint": pa.int16(), "tinyint": pa.int8(),
          "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of a list of plain columns; workers have no session that could parse it."""
    return pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in ddl.split(","))])


def arrow_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder: later plans start there."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Bytes of text of a part, which a task holds as a whole.
PART_BYTES = 3_000_000


def parts_of(docs: DataFrame, text_col: str = "text", part_bytes: int = PART_BYTES) -> int:
    """How many parts to deal texts and keys to: one for every ``part_bytes`` of text, so that a part does not
    grow with the data, and no fewer than give the cluster's tasks some each."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 64
    return max(least, math.ceil(size / part_bytes))


def part_of(columns: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def tidy() -> None:
    """Give back what freed arrays and tables held: a Python worker lives on for later tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"{name}_"
    return name
