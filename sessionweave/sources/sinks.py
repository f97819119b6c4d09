"""Where results and logs go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or on a local master alone the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def overwrite(df: DataFrame, path: str, fmt: str = "parquet", partition: list[str] | None = None) -> None:
    """Replace a whole table; the committer writes aside and renames."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(*partition) if partition else writer).save(path)


def append_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet"):  # noqa: ANN201
    """Durable append: the file sink commits each micro-batch once."""
    return df.writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", path).outputMode("append").start()


def persisted(entries: DataFrame) -> DataFrame:
    """Entries that are on disk: nothing of a session before its first assistant message, but for its state and info rows."""
    upto = Window.partitionBy("session_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ever = Window.partitionBy("session_id")
    spoken = F.max((F.col("type") == "message") & (F.col("role") == "assistant"))
    return entries.withColumn("_spoken", spoken.over(upto)).withColumn("_ever", spoken.over(ever)).where(F.col("_ever") | F.col("type").isin("session_state", "session_info")).drop("_spoken", "_ever")


def packed(df: DataFrame, group: str, order: str, size: Column, limit: int) -> DataFrame:
    """Rows with `bin`: filled in order up to `limit`, a row over the limit alone in its bin.

    One group's rows are folded in order; its sizes alone are read, not its texts.
    """
    keys = df.select(F.col(group).alias("_g"), F.col(order).alias("_o"), size.cast("long").alias("_s"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_o", kind="stable")
        bins, at, used, empty = [], 0, 0, True
        for s in rows["_s"].tolist():
            if not empty and used + s > limit:
                at, used, empty = at + 1, 0, True
            bins.append(at)
            used, empty = used + s, False
        return rows.assign(bin=pd.Series(bins, index=rows.index, dtype="int64"))[["_g", "_o", "bin"]]

    placed = keys.groupBy("_g").applyInPandas(fill, f"_g {df.schema[group].dataType.simpleString()}, _o {df.schema[order].dataType.simpleString()}, bin long")
    return df.join(placed, (df[group] == placed["_g"]) & (df[order] == placed["_o"])).drop("_g", "_o")


def rows_of(df: DataFrame) -> Iterator:
    """Rows one by one, a partition at a time on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)
