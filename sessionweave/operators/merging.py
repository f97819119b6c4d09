"""Set operations in which one side, or the fresher row, wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def freshest(old: DataFrame, new: DataFrame, key: str, updated: str) -> DataFrame:
    """Union by key; the later `updated` wins, a tie goes to new, a missing date loses."""
    both = old.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(updated).desc_nulls_last(), F.col("_rank").desc())
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def first_wins(frames: list[DataFrame], key: Column) -> DataFrame:
    """Union in which the earliest frame that has a key gives its row."""
    both = None
    for i, f in enumerate(frames):
        part = f.withColumn("_rank", F.lit(i))
        both = part if both is None else both.unionByName(part)
    w = Window.partitionBy(key).orderBy("_rank", *(c for c in frames[0].columns))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_rank")


def latest(rows: DataFrame, key: list[str], order: str, deleted: Column | None = None) -> DataFrame:
    """Last row of each key; keys whose last row is a deletion go."""
    w = Window.partitionBy(*key).orderBy(F.col(order).desc())
    out = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out.where(~F.coalesce(deleted, F.lit(False))) if deleted is not None else out


def overlaid(base: DataFrame, override: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """base with the override's non-null fields."""
    o = override.select(key, *(F.col(c).alias(f"_{c}") for c in fields))
    return base.join(o, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop(*(f"_{c}" for c in fields))


def scoped_union(local: DataFrame, shared: DataFrame, key: str, scope: str) -> DataFrame:
    """Union of two keyed tables; a shared key that is local too gets the scope before it."""
    taken = local.select(F.col(key).alias("_k")).distinct()
    renamed = shared.join(taken, F.col(key) == F.col("_k"), "left").withColumn(key, F.when(F.col("_k").isNull(), F.col(key)).otherwise(F.concat(F.lit(f"{scope}:"), F.col(key)))).drop("_k")
    return local.unionByName(renamed)


def deep_merged(base: Column, override: Column) -> Column:
    """Maps of maps merged one level down, the override winning."""
    keys = F.array_union(F.map_keys(base), F.map_keys(override))
    empty = F.create_map().cast("map<string,string>")

    def inner(k: Column) -> Column:
        a, b = F.coalesce(F.try_element_at(base, k), empty), F.coalesce(F.try_element_at(override, k), empty)
        return F.map_concat(F.map_filter(a, lambda key, _: ~F.map_contains_key(b, key)), b)

    return F.map_from_arrays(keys, F.transform(keys, inner))


def idempotent(journal: DataFrame, key: str, order: str, kind: str) -> DataFrame:
    """State of each command: complete with its last result, pending, or gone once acknowledged; results without a receipt are dropped."""
    g = journal.groupBy(key).agg(
        F.min(F.when(F.col(kind) == "received", F.col(order))).alias("received"),
        F.max(F.when(F.col(kind) == "result", F.col(order))).alias("result"),
        F.max(F.when(F.col(kind) == "acknowledged", F.col(order))).alias("acknowledged"),
    )
    done = F.col("result") > F.col("received")
    return g.where(F.col("received").isNotNull() & ~F.coalesce(F.col("acknowledged") > F.col("received"), F.lit(False))).select(key, F.when(done, "complete").otherwise("pending").alias("state"))


def keyed_state(ledger: DataFrame, key: str, order: str, op: str, name: str) -> DataFrame:
    """Spawn, rename and delete by key: the last name since the last spawn, and whether it is deleted."""
    spawned = ledger.where(F.col(op) == "spawn").groupBy(key).agg(F.max(order).alias("_at"))
    after = ledger.join(spawned, key).where(F.col(order) >= F.col("_at"))
    return after.groupBy(key).agg(
        F.max_by(name, F.when(F.col(op).isin("spawn", "rename"), F.col(order))).alias(name),
        F.bool_or(F.col(op) == "delete").alias("deleted"),
    )


def changed(now: DataFrame, before: DataFrame, key: str, signature: list[str]) -> DataFrame:
    """Rows of now that are new or whose signature differs."""
    same = [now[c].eqNullSafe(before[c]) for c in signature]
    on = now[key] == before[key]
    for s in same:
        on = on & s
    return now.join(before, on, "left_anti")
