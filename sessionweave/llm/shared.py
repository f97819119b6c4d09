"""Tables in the folder that all executors share, and small helpers used by several operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a single local JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sessionweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir()


_paths: list[str] = []


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _paths:
        _paths.remove(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that written() made; only for one that no lazy plan still reads."""
    _deleted(df.sparkSession, df._written_at)


def tables() -> set[str]:
    """Where the tables are that this process wrote and has not deleted."""
    return set(_paths)


def dropped_but(df: DataFrame, before: set[str]) -> None:
    """Delete the tables written since before was taken, all but df."""
    for path in tables() - before - {df._written_at}:
        _deleted(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all tables that this process wrote; for when the results built on them are stored."""
    for path in list(_paths):
        _deleted(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_mod(column: Column | str, mod: int) -> Column:
    """crc32 of the id written as text, modulo mod; null ids give null."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % mod
