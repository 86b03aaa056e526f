"""Session helpers: recoverable lineage cuts and size checks."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for intermediate tables. Only a local session without the
    setting (a test) gets one of its own; elsewhere executors could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named or _own_folder()


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="turnwatch-")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, for a written table or a stream."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive lost executors, the plan restarts here."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str = "kept") -> DataFrame:
    """The rows as a table under the shared folder, for loops. A checkpoint hands on the size that the optimizer guessed for its plan;
    where each round joins what the last one left, that number gets twice as many digits every time. A table has its own size."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when the frame has at most ``max_rows`` rows. A plain count is combined in the tasks."""
    return df.count() <= max_rows


@cache
def _shipped(application: str, spark: SparkSession, packages: tuple[Path, ...]) -> None:
    archive = Path(tempfile.mkdtemp(prefix="turnwatch-src-")) / f"{'-'.join(p.name for p in packages)}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for package in packages:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def ship(spark: SparkSession, *packages: Path) -> None:
    """Hand this package (and others) to the Python workers, once per application. Not
    needed where they are installed or passed with ``--py-files``."""
    own = Path(__file__).resolve().parent
    _shipped(spark.sparkContext.applicationId, spark, (own, *packages))


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000, max_bytes: int = 64_000_000) -> DataFrame:
    """Hint a broadcast only after its rows and the size of their values were summed up; otherwise
    leave the join to shuffle."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return F.broadcast(df) if rows <= max_rows and size <= max_bytes else df


def _width(column: Column, kind: DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, StringType | BinaryType | ArrayType | StructType | MapType):
            return F.coalesce(F.aggregate(F.transform(column, lambda x: _width(x, kind.elementType).cast("long")), F.lit(0).cast("long"),
                                          lambda a, x: a + x), F.lit(0))
        return F.coalesce(F.size(column), F.lit(0)) * 8
    if isinstance(kind, MapType):
        return _width(F.map_keys(column), ArrayType(kind.keyType)) + _width(F.map_values(column), ArrayType(kind.valueType))
    if isinstance(kind, StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind), F.lit(0))
    return F.lit(8)


def spread(df: DataFrame) -> DataFrame:
    """Give costly per-row work to the whole cluster when a table comes in fewer partitions than
    there are cores. Only for frames that are a plain read: counting the partitions of anything with a shuffle would run it."""
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
