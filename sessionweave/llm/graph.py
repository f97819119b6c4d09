"""Connected components of an edge table, by alternating stars, in the cluster alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, partitions, written


def _apart(least: DataFrame) -> DataFrame:
    """Dealt anew, so that the join on a node is planned by itself and a hub's links can be split."""
    return least.repartition(partitions(least.sparkSession)).hint("merge")


def _large(e: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the least node it sees."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _apart(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(e: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _apart(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of ids to (node, component): component is the least id reachable.

    Null ids and loops are ignored; ids without a link do not appear. The two-step round halves what
    is left at least, so rounds grow with the logarithm of the longest path.
    """
    e = written(edges.select("a", "b").where("a != b").distinct(), "links")
    before = None
    while True:
        now = written(_small(_large(e)), "stars")
        dropped(e)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        e = now
        if state == before:
            break
        before = state
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
