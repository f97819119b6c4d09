"""Joins of calls with results, of facts with dimensions, and of records under several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched_calls(log: DataFrame, scope: str, order: str, key: str, is_call: Column, is_result: Column) -> DataFrame:
    """Calls and results of one scope with `call` (order of the call that a result answers) and `state`.

    Only a later result answers a call, the first one uses it up, and a call whose key is used again
    before is left open. state is, for calls: resolved, missing_result, or replaced; for results:
    matched or unmatched. One sort by (scope, key, order).
    """
    w = Window.partitionBy(scope, key).orderBy(order)
    rows = log.where(is_call | is_result).withColumn("_call", is_call)
    rows = rows.withColumn("_before", F.lag("_call").over(w)).withColumn("_after", F.lead("_call").over(w)).withColumn("_prior", F.lag(order).over(w))
    state = (
        F.when(F.col("_call") & F.col("_after").isNull(), "missing_result")
        .when(F.col("_call") & F.col("_after"), "replaced")
        .when(F.col("_call"), "resolved")
        .when(F.col("_before"), "matched")
        .otherwise("unmatched")
    )
    return rows.withColumn("state", state).withColumn("call", F.when(F.col("state") == "matched", F.col("_prior"))).drop("_call", "_before", "_after", "_prior")


def latest_call(calls: DataFrame, results: DataFrame, key: str, order: str, *keep: str) -> DataFrame:
    """Each result with the last call of its key before it, in the order of all files; the call stays in use."""
    both = calls.select(key, order, F.struct(*keep).alias("_call"), F.lit(False).alias("_result")).unionByName(
        results.select(key, order, F.lit(None).cast(calls.select(F.struct(*keep).alias("s")).schema["s"].dataType).alias("_call"), F.lit(True).alias("_result"))
    )
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_call", F.last("_call", ignorenulls=True).over(w)).where("_result")
    return found.select(key, order, *(F.col(f"_call.{c}").alias(c) for c in keep))


def with_dimension(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Left lookup; the planner broadcasts the dimension while it is under its size limit."""
    return facts.join(dim, on, "left")


def attributed(messages: DataFrame, attributions: DataFrame, scope: str, key: str, order: str, value: str) -> DataFrame:
    """messages with `net`: value less the last attribution to each, zero at least."""
    last = attributions.groupBy(scope, key).agg(F.max_by(value, order).alias("_child"))
    joined = messages.join(last, [scope, key], "left")
    return joined.withColumn("net", F.greatest(F.col(value) - F.coalesce("_child", F.lit(0)), F.lit(0))).drop("_child")


def reconciled(live: DataFrame, saved: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Full outer join in which the live value wins; `origin` says who had the row."""
    a, b = live.alias("a"), saved.alias("b")
    out = a.join(b, F.col(f"a.{on}") == F.col(f"b.{on}"), "full_outer")
    origin = F.when(F.col(f"b.{on}").isNull(), "live").when(F.col(f"a.{on}").isNull(), "saved").otherwise("both")
    return out.select(F.coalesce(f"a.{on}", f"b.{on}").alias(on), *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in fields), origin.alias("origin"))


def by_alias(left: DataFrame, left_id: str, left_aliases: str, right: DataFrame, right_id: str, right_aliases: str) -> DataFrame:
    """(left_id, right_id): for each left row, the right row under its first alias that hits.

    An equi-join on exploded aliases, so many names per row need no cross product.
    """
    a = left.select(left_id, F.posexplode(left_aliases).alias("rank", "alias"))
    b = right.select(right_id, F.explode(right_aliases).alias("alias"))
    hit = a.join(b, "alias")
    return hit.groupBy(left_id).agg(F.min_by(right_id, F.struct("rank", right_id)).alias(right_id))


def identity_aliases(**names: Column) -> Column:
    """Names as `kind:value`, in order, nulls and empties left out."""
    each = (F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"{k}:"), v.cast("string"))) for k, v in names.items())
    return F.array_compact(F.array(*each))


def family(rows: DataFrame, id_: str, parent: str) -> DataFrame:
    """(id, relative, relation) over parent, child and sibling; siblings share a parent that is there."""
    base = rows.select(id_, parent)
    up = base.where(F.col(parent).isNotNull()).join(base.select(F.col(id_).alias("relative")), F.col(parent) == F.col("relative"), "left_semi").select(F.col(id_), F.col(parent).alias("relative"), F.lit("parent").alias("relation"))
    down = up.select(F.col("relative").alias(id_), F.col(id_).alias("relative"), F.lit("child").alias("relation"))
    a, b = up.alias("a"), up.alias("b")
    sides = a.join(b, (F.col("a.relative") == F.col("b.relative")) & (F.col(f"a.{id_}") != F.col(f"b.{id_}"))).select(F.col(f"a.{id_}").alias(id_), F.col(f"b.{id_}").alias("relative"), F.lit("sibling").alias("relation"))
    return up.unionByName(down).unionByName(sides)


def live_edges(edges: DataFrame, files: DataFrame, parent: str, child: str, path: str) -> DataFrame:
    """Edges both of whose ends are there."""
    return edges.join(files, F.col(parent) == files[path], "left_semi").join(files, F.col(child) == files[path], "left_semi")


def either(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """A join on a = b or c = d, as a union of equi-joins without doubles."""
    out = None
    for a, b in pairs:
        part = left.join(right, left[a] == right[b]).select(*keep)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def with_missing_results(calls: DataFrame, results: DataFrame, scope: str, key: str, note: str) -> DataFrame:
    """Results, and one made up for every call that has none, in its call's place."""
    lost = calls.join(results, [scope, key], "left_anti").select(scope, key, "line", F.lit(note).alias("text"), F.lit(True).alias("synthetic"))
    return results.select(scope, key, "line", "text", F.lit(False).alias("synthetic")).unionByName(lost)
