"""Operators over the order of entries in a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_valid(rows: DataFrame, key: str, order: str, value: str, valid: Column) -> DataFrame:
    """The last valid value of each key, null where none is."""
    return rows.groupBy(key).agg(F.max_by(value, F.when(valid, F.col(order))).alias(value))


def last_value(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last row's value even if blank, which clears it."""
    return rows.groupBy(key).agg(F.nullif(F.trim(F.max_by(F.coalesce(value, F.lit("")), order)), F.lit("")).alias(value))


def turn_starts(rows: DataFrame, session: str, order: str, is_start: Column) -> DataFrame:
    """rows with `turn_start`: the order of the nearest start at or before each."""
    w = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("turn_start", F.last(F.when(is_start, F.col(order)), ignorenulls=True).over(w))


def cut_points(rows: DataFrame, session: str, order: str, tokens: str, is_message: Column, can_cut: Column, stops: Column, is_user: Column, is_start: Column, budget: int) -> DataFrame:
    """(session, first_kept, turn_start, split): where to cut so that about `budget` tokens stay.

    From the newest message back, tokens are summed up to the budget; the cut is the first valid
    place from there on, or the first of all, and moves back over rows that are no messages.
    `stops` marks rows that end this move (messages and compactions).
    """
    back = Window.partitionBy(session).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    fore = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(session)
    r = (
        rows.withColumn("_sum", F.sum(F.when(is_message, F.col(tokens)).otherwise(0)).over(back))
        .withColumn("_crossed", F.max(F.when(is_message & (F.col("_sum") >= budget), F.col(order))).over(all_))
        .withColumn("_begin", F.min(order).over(all_))
        .withColumn("_first", F.min(F.when(can_cut, F.col(order))).over(all_))
        .withColumn("_near", F.min(F.when(can_cut & (F.col(order) >= F.col("_crossed")), F.col(order))).over(all_))
        .withColumn("_stop", F.max(F.when(stops, F.col(order))).over(before))
        .withColumn("_next", F.min(F.when(~stops, F.col(order))).over(Window.partitionBy(session, "_stop")))
        .withColumn("_start", F.last(F.when(is_start, F.col(order)), ignorenulls=True).over(fore))
        .withColumn("_user", F.coalesce(is_user, F.lit(False)))
    )
    cut = F.coalesce("_near", "_first")
    # the rows between a stop and the cut are no messages: the first of them is where the cut ends up
    at = r.where(F.col(order) == cut).select(session, F.least(F.col(order), F.coalesce("_next", F.col(order))).alias("first_kept"))
    kept = r.select(session, F.col(order).alias("first_kept"), "_user", "_start").join(at, [session, "first_kept"])
    out = kept.select(session, "first_kept", F.when(~F.col("_user"), F.col("_start")).alias("turn_start"))
    none = rows.groupBy(session).agg(F.min(order).alias("_begin"))
    joined = none.join(out, session, "left").select(session, F.coalesce("first_kept", "_begin").alias("first_kept"), "turn_start")
    return joined.withColumn("split", F.col("turn_start").isNotNull())


def context_estimate(rows: DataFrame, session: str, order: str, usage: Column, usable: Column, is_compaction: Column, estimate: Column) -> DataFrame:
    """(session, tokens): last usable usage after the last compaction plus estimates of what follows it; null without one."""
    all_ = Window.partitionBy(session)
    r = rows.withColumn("_cut", F.coalesce(F.max(F.when(is_compaction, F.col(order))).over(all_), F.lit(-1)))
    r = r.withColumn("_last", F.max(F.when(usable & (F.col(order) > F.col("_cut")), F.col(order))).over(all_))
    base = F.max(F.when(F.col(order) == F.col("_last"), usage))
    return r.groupBy(session).agg((base + F.coalesce(F.sum(F.when(F.col(order) > F.col("_last"), estimate)), F.lit(0))).alias("tokens"))


def context_after_compaction(rows: DataFrame, session: str, order: str, is_compaction: Column, first_kept: str) -> DataFrame:
    """Rows in context with `rank`: the last compaction, rows kept before it, rows after it."""
    all_ = Window.partitionBy(session)
    last = F.max(F.when(is_compaction, F.col(order))).over(all_)
    r = rows.withColumn("_cut", last)
    r = r.withColumn("_from", F.max(F.when(F.col(order) == F.col("_cut"), F.col(first_kept))).over(all_))
    here = F.col("_cut").isNull() | (F.col(order) == F.col("_cut")) | (F.col(order) > F.col("_cut")) | (F.col(order) >= F.col("_from"))
    place = Window.partitionBy(session).orderBy(F.when(F.col(order) == F.col("_cut"), 0).otherwise(1), F.col(order))
    return r.where(here & (~is_compaction | (F.col(order) == F.col("_cut")))).withColumn("rank", F.row_number().over(place)).drop("_cut", "_from")


def within_budget(rows: DataFrame, session: str, order: str, tokens: str, is_summary: Column, budget: int) -> DataFrame:
    """Newest rows within a budget; the first row over it stays if it is a summary and under 90 % was used before."""
    back = Window.partitionBy(session).orderBy(F.col(order).desc())
    r = rows.withColumn("_sum", F.sum(tokens).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    first_over = F.max(F.when(F.col("_sum") > budget, F.col(order))).over(Window.partitionBy(session))
    r = r.withColumn("_over", first_over)
    spare = (F.col(order) == F.col("_over")) & is_summary & (F.col("_sum") - F.col(tokens) < 0.9 * budget)
    return r.where(F.col("_over").isNull() | (F.col(order) > F.col("_over")) | spare).drop("_sum", "_over")


def sequenced(rows: DataFrame, session: str, order: str) -> DataFrame:
    """rows with `seq`, counted from 1 in each session."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long"))


def illegal_moves(rows: DataFrame, key: str, order: str, state: str, legal: DataFrame) -> DataFrame:
    """Rows whose state may not follow the state before; legal has (before, after)."""
    w = Window.partitionBy(key).orderBy(order)
    moves = rows.withColumn("before", F.lag(state).over(w)).where("before is not null").withColumn("after", F.col(state))
    return moves.join(legal, ["before", "after"], "left_anti")


def linear_parents(rows: DataFrame, session: str, order: str, id_: str) -> DataFrame:
    """rows with `parent`: the id before."""
    return rows.withColumn("parent", F.lag(id_).over(Window.partitionBy(session).orderBy(order)))


def inherited(rows: DataFrame, scope: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with `name`: the last non-null value so far."""
    w = Window.partitionBy(scope).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))
