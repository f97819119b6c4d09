"""Trees given by parent pointers: paths, descendants, roll-ups, common ancestors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionweave.sources.sinks import scratch


def _cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, so that its lineage ends there; made in one pass."""
    path = f"{scratch(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _climbed(nodes: DataFrame, state: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int = 64) -> DataFrame:
    """state (id, ...) after step(state, jumps) with jumps (id, up) of 1, 2, 4, ... edges, while any is left.

    Every round works on one row per node, whatever the depth. A cycle ends once jumps are longer than
    there are nodes.
    """
    n = nodes.count()
    jumps = _cut(nodes.where("up is not null and id != up").select("id", "up"))
    for k in range(most_rounds):
        if jumps.isEmpty() or 1 << k > n:
            break
        state = _cut(step(state, jumps))
        jumps = _cut(jumps.join(jumps.select(F.col("id").alias("up"), F.col("up").alias("_far")), "up").select("id", F.col("_far").alias("up")))
    return state


def _pointers(edges: DataFrame, id_: str, parent: str) -> DataFrame:
    """(id, up): parents that are there; no node is its own."""
    there = edges.select(F.col(id_).alias("up")).distinct()
    return edges.select(F.col(id_).alias("id"), F.col(parent).alias("up")).join(there.withColumn("_is", F.lit(True)), "up", "left").select("id", F.when(F.col("_is") & (F.col("up") != F.col("id")), F.col("up")).alias("up"))


def _doubled(state: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = 64) -> DataFrame:
    """state (id, up, ...) after step(state), which keeps id and up, for jumps up of 1, 2, 4, ... edges.

    One table is written per round; otherwise as _climbed().
    """
    state = _cut(state)
    n = state.count()
    for k in range(most_rounds):
        if 1 << k > n or state.where("up is not null").isEmpty():
            break
        far = state.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        state = _cut(step(state).join(far, "up", "left").withColumn("up", F.col("_next")).drop("_next"))
    return state.drop("up")


def totals(nodes: DataFrame, id_: str, parent: str, value: str) -> DataFrame:
    """(id, total, descendants): a node's own value and all below it, by sums that double in depth."""

    def step(state: DataFrame) -> DataFrame:
        below = state.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("_t"), F.sum("n").alias("_n"))
        return state.join(below, "id", "left").select("id", "up", (F.col("total") + F.coalesce("_t", F.lit(0))).alias("total"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))

    own = nodes.select(F.col(id_).alias("id"), F.col(value).alias("total"), F.lit(1).cast("long").alias("n"))
    out = _doubled(_pointers(nodes, id_, parent).join(own, "id"), step)
    return out.select(F.col("id").alias(id_), "total", (F.col("n") - 1).alias("descendants"))


def inherited(nodes: DataFrame, id_: str, parent: str, value: Column, own: bool = True) -> DataFrame:
    """(id, value): the nearest non-null value at or above each node, or above it alone."""
    up = _pointers(nodes, id_, parent)
    held = nodes.select(F.col(id_).alias("id"), value.alias("value"))
    above = held.select(F.col("id").alias("up"), F.col("value").alias("value"))
    first = up.join(held, "id") if own else up.join(above, "up", "left")

    def step(state: DataFrame) -> DataFrame:
        far = state.select(F.col("id").alias("up"), F.col("value").alias("_far"))
        return state.join(far, "up", "left").select("id", "up", F.coalesce("value", "_far").alias("value"))

    return _doubled(first.select("id", "up", "value"), step).withColumnRenamed("id", id_)


def paths_up(edges: DataFrame, id_: str, parent: str, asked: DataFrame) -> DataFrame:
    """(descendant, ancestor, distance) as closure() has it, for the asked ids (a column `id`) alone."""
    first = asked.select(F.col("id").alias("descendant"), F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance")).distinct()
    there = edges.select(F.col(id_).alias("ancestor")).distinct()
    k = [0]

    def step(state: DataFrame, jumps: DataFrame) -> DataFrame:
        far = state.join(jumps.select(F.col("id").alias("ancestor"), "up"), "ancestor").select("descendant", F.col("up").alias("ancestor"), (F.col("distance") + (1 << k[0])).alias("distance"))
        k[0] += 1
        return state.unionByName(far).groupBy("descendant", "ancestor").agg(F.min("distance").alias("distance"))

    return _climbed(edges.select(F.col(id_).alias("id"), F.col(parent).alias("up")), first.join(there, "ancestor", "left_semi"), step)


def closure(edges: DataFrame, id_: str, parent: str, checkpoint=None, most_rounds: int = 64) -> DataFrame:  # noqa: ANN001
    """(descendant, ancestor, distance) of every node, itself at 0. A cycle is followed once around.

    A chain of n nodes has n * n / 2 such rows: totals(), inherited() and paths_up() answer most
    questions without them. Paths double in length each round, so rounds grow with the logarithm of
    the depth. `checkpoint` maps a frame to one with its lineage cut; by default the session's
    checkpoint folder is used.
    """
    cut = checkpoint or _cut
    pairs = edges.select(F.col(id_).alias("descendant"), F.col(parent).alias("ancestor")).where("ancestor is not null and descendant != ancestor").distinct()
    nodes = edges.select(F.col(id_).alias("descendant")).distinct()
    known = cut(pairs.withColumn("distance", F.lit(1).cast("long")))
    n = known.count()
    for _ in range(most_rounds):
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.descendant")).select("a.descendant", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        wider = known.unionByName(longer.where("descendant != ancestor")).groupBy("descendant", "ancestor").agg(F.min("distance").alias("distance"))
        known = cut(wider)
        m = known.count()
        if m == n:
            break
        n = m
    return known.unionByName(nodes.select("descendant", F.col("descendant").alias("ancestor"), F.lit(0).cast("long").alias("distance")))


def walked(log: DataFrame, session: str, order: str, id_: str, parent: str) -> DataFrame:
    """(session, id, step) of the path from each session's leaf, its last entry, to the root; step 0 is the root.

    One session's ids are walked in one task; texts stay where they are. Cycles end the walk.
    """
    keys = log.select(F.col(session).alias("s"), F.col(order).alias("o"), F.col(id_).alias("i"), F.col(parent).alias("p"))
    kind = keys.schema

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("o")
        up, at, path, seen = dict(zip(rows["i"], rows["p"], strict=True)), rows["i"].iloc[-1], [], set()
        while at is not None and at in up and at not in seen:
            path.append(at)
            seen.add(at)
            at = up[at]
        return pd.DataFrame({"s": rows["s"].iloc[0], "i": path[::-1], "step": range(len(path))})

    return keys.groupBy("s").applyInPandas(walk, f"s {kind['s'].dataType.simpleString()}, i {kind['i'].dataType.simpleString()}, step long").select(F.col("s").alias(session), F.col("i").alias(id_), "step")


def rollup(nodes: DataFrame, closed: DataFrame, id_: str, value: str) -> DataFrame:
    """(id, total, descendants): own value and all below; partial sums go before the shuffle by ancestor."""
    below = closed.join(nodes, closed.descendant == nodes[id_])
    return below.groupBy(F.col("ancestor").alias(id_)).agg(F.sum(value).alias("total"), (F.count("*") - 1).alias("descendants"))


def subtree(closed: DataFrame, roots: DataFrame, id_: str) -> DataFrame:
    return closed.join(roots, closed.ancestor == roots[id_], "left_semi").select(F.col("descendant").alias(id_)).distinct()


def with_ancestors(closed: DataFrame, hits: DataFrame, id_: str) -> DataFrame:
    """Matches and everything above them."""
    return closed.join(hits, closed.descendant == hits[id_], "left_semi").select(F.col("ancestor").alias(id_)).distinct()


def common_ancestor(closed: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with `common`: the nearest node above both."""
    x = closed.select(F.col("descendant").alias(a), F.col("ancestor").alias("common"), F.col("distance").alias("da"))
    y = closed.select(F.col("descendant").alias(b), F.col("ancestor").alias("common"), F.col("distance").alias("db"))
    both = pairs.join(x, a).join(y, [b, "common"])
    return both.groupBy(a, b).agg(F.min_by("common", F.struct("da", "common")).alias("common"))


def promoted(nodes: DataFrame, id_: str, parent: str) -> DataFrame:
    """nodes with orphans made roots."""
    there = nodes.select(F.col(id_).alias("_p")).distinct()
    return nodes.join(there, F.col(parent) == F.col("_p"), "left").withColumn(parent, F.col("_p")).drop("_p")


def nearest(closed: DataFrame, shown: DataFrame, id_: str) -> DataFrame:
    """(id, parent): each shown node's nearest shown ancestor, null for none."""
    up = closed.where("distance > 0").join(shown.select(F.col(id_).alias("ancestor")), "ancestor", "left_semi")
    best = up.groupBy(F.col("descendant").alias(id_)).agg(F.min_by("ancestor", "distance").alias("parent"))
    return shown.select(id_).join(best, id_, "left")


def children(nodes: DataFrame, id_: str, parent: str, order: Column) -> DataFrame:
    """(id, n_children, first_child) of nodes that have any."""
    return nodes.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(id_)).agg(F.count("*").alias("n_children"), F.min_by(id_, order).alias("first_child"))


def preorder(nodes: DataFrame, closed: DataFrame, id_: str, order: str) -> DataFrame:
    """nodes with `path`, by which sorting gives the pre-order listing, and `depth`."""
    keys = nodes.select(F.col(id_).alias("ancestor"), F.struct(F.col(order), F.col(id_)).alias("k"))
    steps = closed.join(keys, "ancestor").groupBy("descendant").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "k"))), lambda s: s["k"]).alias("path"))
    return nodes.join(steps, nodes[id_] == steps.descendant).drop("descendant").withColumn("depth", F.size("path") - 1)
