"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantables.llm.common import Cut

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> Cut:
    """Larger neighbours of each node to the smallest of its neighbours and itself.

    The smallest are summed within tasks and written before they are joined,
    as are the edges: one node may have most of all edges, and only of a
    written table does Spark know that it may be broadcast, or where to split.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = Cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), "least")
    out = Cut(both.filter("b > a").join(least.df, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
    least.drop()
    return out


def _small_star(edges: DataFrame) -> Cut:
    """Smaller neighbours of each node, and itself, to the smallest of them; least and edges as above."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b")
    least = Cut(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    turned = down.join(least.df, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    out = Cut(turned.filter("a > b").distinct(), "edges")
    least.drop()
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b longs) -> (node, label): the smallest node reachable, for every node with an edge.

    Each round is two joins on node keys; stars end as (node, smallest node)
    pairs. The driver sees only a count and a hash of the edge table. Self
    edges and repeats are allowed; no edges give no rows.
    """
    now = Cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    seal = None
    for _ in range(MAX_ROUNDS):
        large = _large_star(now.df)
        now.drop()
        after = _small_star(large.df)
        large.drop()
        now = after
        mark = tuple(now.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seal:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.df.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        seal = mark
    raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
