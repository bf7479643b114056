"""Connected components by alternating large-star and small-star rounds, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """(node, component) for every node of ``edges``; ``component`` is the smallest node of the component.

    Nodes may be of any ordered type. Self-loops, repeated and reversed edges change nothing; edges with a
    null end are left out; an edge from a node to itself alone still gives that node a row. Every round is
    cut into the shared folder; rounds grow with the logarithm of the largest component, squared at worst.
    Minima are pre-aggregated before each shuffle, so a node with a third of all edges is no hot key."""
    given = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    alone = given.where("a = b").select(F.col("a").alias("node")).distinct()
    star = cut(given.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    for _ in range(most_rounds):
        if not _unsettled(star):
            break
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(star.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(floor, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        star = cut(moved.unionByName(floor.withColumnRenamed("m", "lo")).distinct(), "star")
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    labels = star.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = star.select(F.col("lo").alias("node")).distinct()
    loops = alone.join(labels.select("node").unionByName(roots), "node", "left_anti")
    return labels.unionByName(roots.unionByName(loops).select("node", F.col("node").alias("component")))


def _unsettled(star: DataFrame) -> bool:
    """True unless every node either points to one lower node or is pointed to."""
    ends = star.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(star.select(F.col("lo").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return bool(ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count())
