"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is grouping by a node with a minimum (combined before the shuffle) and a join; a hub's rows may be split by
adaptive execution. Edges, labels and components stay distributed; each round is written to the shared folder. The number of
rounds grows with the logarithm of the size of a component; edges that are stars already take none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has rows (u, v) with v < u. Join all larger (or smaller) neighbours of a node to its least one."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        rows = both.where(F.col("v") > F.col("u")).join(least, "u")
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        rows = edges.join(least, "u")
        rows = rows.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m"))
    return rows.where(F.col("v") != F.col("m")).select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether ``edges`` (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out")))
    each = ends.groupBy("u").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    return not each.agg(F.max((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("least") == 0)))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node that has an edge to another."""
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "edges")
    for _ in range(rounds):
        if _settled(e):
            break
        e = materialize(_star(_star(e, True), False), "stars")
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
