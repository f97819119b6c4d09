"""Orders with several keys, tiers of matches, nearest names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worst(edits: DataFrame, ratio: str, size: str, path: str, k: int) -> DataFrame:
    """Largest ratio first, an endless one (null) before all; then size, then path in dictionary order."""
    return edits.orderBy(F.col(ratio).desc_nulls_first(), F.col(size).desc(), F.collate(F.col(path), "UNICODE"), F.col(path)).limit(k)


def tier(name: Column, *others: Column, query: str) -> Column:
    """Rank of the best match: whole, start, part, over the fields in order; null for none."""
    q, fields = query.lower(), [F.lower(c) for c in (name, *others)]
    out, n = F, len(fields)
    for t, test in enumerate((lambda c: c == q, lambda c: c.startswith(q), lambda c: c.contains(q))):
        for i, c in enumerate(fields):
            out = out.when(test(c), t * n + i)
    return out


def tiered(rows: DataFrame, rank: Column, order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rank", rank).where("rank is not null").orderBy("rank", *order).limit(k)


def unique_match(rows: DataFrame, test: Column) -> DataFrame:
    """The row that passes, if one alone does."""
    # two rows at most, so one task may hold them
    return rows.where(test).limit(2).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0)))).where("_n = 1").drop("_n")


def closest(rows: DataFrame, id_: str, query: str) -> DataFrame:
    """The id nearest by edits, if one alone is and it is within a fifth of the length (1 at least)."""
    most = max(1, len(query) // 5)
    near = rows.select(id_, F.levenshtein(F.col(id_), F.lit(query)).alias("edits")).where(F.col("edits") <= most)
    best = near.groupBy("edits").agg(F.count("*").alias("n"), F.min(id_).alias(id_)).orderBy("edits").limit(1)
    return best.where("n = 1").select(id_, "edits")


def first_tier(tiers: list[DataFrame]) -> DataFrame:
    """Rows of the first frame that has any."""
    out = None
    for i, t in enumerate(tiers):
        part = t.withColumn("_tier", F.lit(i))
        out = part if out is None else out.unionByName(part)
    best = out.agg(F.min("_tier").alias("_best"))
    return out.join(F.broadcast(best), F.col("_tier") == F.col("_best")).drop("_tier", "_best")


def top_per_group(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
