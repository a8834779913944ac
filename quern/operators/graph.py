"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step is a min aggregate (combined before the shuffle) and an equi-join (split by AQE where one
node holds many edges); no neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rows: int | None = None, max_rounds: int = 60) -> DataFrame:
    """edges (a, b): undirected, of any orderable type, self-loops, repeats and nulls allowed (and
    ignored). Returns (node, root) for every node that has a neighbour; root is the smallest node of
    its component. Nodes without an edge are not listed: they are their own root. rows: the number of
    edges, where it is known, so that a small graph is written as few files."""
    e = (
        edges.where((F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    e = scratch.write(e, "cc", rows)
    before = None
    for _ in range(max_rounds):
        sym = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = sym.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = sym.join(low, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct()
        )
        new = scratch.write(small, "cc", rows)
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(e)
        e, rows = new, now[0]
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
