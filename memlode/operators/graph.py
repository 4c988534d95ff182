"""Graph iterations on edge DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlode.session import Scratch


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected edge list (src, dst): one row (node, root) per node that is
    not its own root; root is the least node of the component.

    Large-star / small-star rounds.  Every round is two map-side combined minima and two equi-joins,
    never a collected neighbour list, so a hub with most of the edges is only a skewed join key that
    adaptive execution splits.  Lineage is cut each round by a written table.  Raises RuntimeError if
    ``max_rounds`` rounds do not reach the end.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    cur = scratch.keep(
        edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u > v").distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        nxt = scratch.keep(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).where("u > v").distinct())
        mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(cur)
        cur = nxt
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components are not done after {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
