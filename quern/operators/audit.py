"""Audits of the identity graph: degrees, thresholds and filters against components, giant and rest, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import connected_components
from quern.plans.scratch import Scratch

THRESHOLDS = (0.30, 0.31, 0.35, 0.40, 0.50, 0.70, 0.90)


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("i").alias("node"), F.col("j").alias("peer"), "si").union(edges.select(F.col("j").alias("node"), F.col("i").alias("peer"), "si"))


def degrees(edges: DataFrame, nodes: DataFrame, idx: str = "entity_idx", length: str = "length", sources: str = "sources") -> DataFrame:
    """degree, degree across sources (no source in common), shortest and longest neighbour of every node."""
    n = nodes.select(F.col(idx).alias("peer"), F.col(length).alias("peer_length"), F.col(sources).alias("peer_sources"))
    own = nodes.select(F.col(idx).alias("node"), F.col(sources).alias("own_sources"))
    e = symmetric(edges).join(n, "peer").join(own, "node")
    d = e.groupBy("node").agg(
        F.count("*").alias("degree"), F.count_if(~F.arrays_overlap("own_sources", "peer_sources")).alias("cross_source_degree"),
        F.min("peer_length").alias("neighbor_min_length"), F.max("peer_length").alias("neighbor_max_length"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("degree", "cross_source_degree", "neighbor_min_length", "neighbor_max_length")}
    return nodes.join(d, F.col(idx) == F.col("node"), "left").drop("node").withColumns(zero)


def bridges(deg: DataFrame, limit: int = 500, idx: str = "sequence_sha256", length: str = "length") -> DataFrame:
    """The best connected nodes: by degree, then shorter, then hash."""
    return deg.orderBy(F.desc("degree"), F.asc(length), F.asc(idx)).limit(limit)


def edge_predicates(a: str, b: str, motifs: list[str]) -> dict[str, Column]:
    """Name to predicate over an edge whose ends' sequences are columns a and b."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    clear = ~(F.col(a).rlike("[XB]") | F.col(b).rlike("[XB]"))
    free = F.lit(True)
    for m in motifs:
        free = free & ~F.contains(F.col(a), F.lit(m)) & ~F.contains(F.col(b), F.lit(m))
    ratio = short / long
    return {
        "none": F.lit(True), "min_length_30": short >= 30, "min_length_50": short >= 50, "min_length_100": short >= 100, "no_ambiguous": clear, "no_motif": free,
        "ratio_50": ratio >= 0.5, "ratio_80": ratio >= 0.8, "conservative": (short >= 50) & clear & free & (ratio >= 0.5),
    }


def keyed_components(edges: DataFrame, nodes: DataFrame, key: str, scratch: Scratch, idx: str = "entity_idx", values: list | None = None) -> DataFrame:
    """(key, node, root) of several graphs at once: edges (key, i, j); every node is in every graph.
    values: the keys, where some may have no edge."""
    e = edges.select(F.struct(F.col(key).alias("k"), F.col("i").alias("x")).alias("a"), F.struct(F.col(key).alias("k"), F.col("j").alias("x")).alias("b"))
    cc = connected_components(e, scratch).select(F.col("node.k").alias(key), F.col("node.x").alias("node"), F.col("root.x").alias("root"))
    keys = edges.sparkSession.createDataFrame([(v,) for v in values], edges.select(key).schema) if values else edges.select(key).distinct()
    every = keys.crossJoin(nodes.select(F.col(idx).alias("node")))  # a few keys
    return every.join(cc, [key, "node"], "left").withColumn("root", F.coalesce("root", "node"))


def component_summary(members: DataFrame, key: list[str]) -> DataFrame:
    """components, largest, singletons, non_singleton_entities for each key."""
    sizes = members.groupBy(*key, "root").agg(F.count("*").alias("k"))
    return sizes.groupBy(*key).agg(
        F.count("*").alias("components"), F.max("k").alias("largest"), F.count_if(F.col("k") == 1).alias("singletons"),
        F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("non_singleton_entities"),
    )


def threshold_sensitivity(edges: DataFrame, nodes: DataFrame, scratch: Scratch, thresholds=THRESHOLDS, idx: str = "entity_idx") -> DataFrame:
    t = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda x: F.col("si") >= x))
    k = edges.select(t.alias("threshold"), "i", "j")
    return component_summary(keyed_components(k, nodes, "threshold", scratch, idx, [float(x) for x in thresholds]), ["threshold"])


def quantile_summary(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Minimum, tenth, median, ninetieth and maximum by linear interpolation."""
    q = df.groupBy(*by).agg(F.percentile(col, [0.0, 0.1, 0.5, 0.9, 1.0]).alias("q"))
    return q.select(*by, *[F.col("q")[k].alias(f"{col}_{n}") for k, n in enumerate(("min", "p10", "median", "p90", "max"))])


def histogram(df: DataFrame, col: str, edges: list[float]) -> DataFrame:
    """(lower, upper, n) of half-open bins; empty bins are listed."""
    spark = df.sparkSession
    b = sum((F.when(F.col(col) >= x, 1).otherwise(0) for x in edges[1:-1]), F.lit(0))
    got = df.where((F.col(col) >= edges[0]) & (F.col(col) < edges[-1])).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.createDataFrame([(k, float(lo), float(hi)) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))], "bin int, lower double, upper double")
    return bins.join(got, "bin", "left").select("lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))
