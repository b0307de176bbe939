"""Connected components of a graph given as edges, by large-star / small-star rounds.

Each round moves every node's edges to the smallest neighbour; the rounds end when no edge
changes, after about log(n) of them. All steps are joins and aggregates that Spark can
split, and every round is written to the shared folder, so a lost executor costs one round; the round
before is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import discard, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _print(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge but the components' smallest nodes.

    ``component`` is the smallest node reachable. Edges may repeat, stand in either
    direction or lead from a node to itself; edges with a null end are ignored. A node
    that is absent from the result is its own component.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y"))
    edges = materialise(edges.where("x IS NOT NULL AND y IS NOT NULL AND a > b").select("a", "b").distinct())
    before = _print(edges)
    while before[0]:
        last = edges
        edges = materialise(_small_star(_large_star(last)))
        discard(last)
        now = _print(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
