"""Allocation of components to train, validation and test, and the validation of a split."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.scalar import value_bin

SPLITS = ("train", "validation", "test")
FRACTIONS = {"train": 0.75, "validation": 0.10, "test": 0.15}
SEED = 20260828


def component_features(entities: DataFrame, obs: DataFrame, component: str = "component", kind: str = "target_kind") -> DataFrame:
    """(component, feature, value): entities, observations, source:*, binary:source:label, value_bin:k."""
    per = obs.withColumn(
        "feature",
        F.explode(F.array_compact(F.array(
            F.lit("observations"), F.concat(F.lit("source:"), "source_dataset"),
            F.when(F.col(kind) == "binary", F.concat(F.lit("binary:"), "source_dataset", F.lit(":"), F.col("target_value").cast("int").cast("string"))),
            F.when(F.col(kind) == "continuous", F.concat(F.lit("value_bin:"), value_bin(F.col("target_value")).cast("string"))),
        ))),
    )
    counts = per.groupBy(component, "feature").agg(F.count("*").alias("value"))
    own = entities.groupBy(component).agg(F.count("*").alias("value")).select(component, F.lit("entities").alias("feature"), "value")
    return own.union(counts.select(component, "feature", "value"))


def feature_weight(name: str) -> float:
    kind = name.partition(":")[0]
    return {"value_bin": 4.0, "binary": 2.0, "source": 1.5, "entities": 4.0}.get(kind, 1.0)


def allocate(features: DataFrame, component: str = "component", fractions: dict[str, float] = FRACTIONS, seed: int = SEED) -> DataFrame:
    """(component, split). The largest component goes to train; the others, largest first, each go where
    the weighted squared error against the target totals, relative to the targets, grows least.

    The choice depends on all before it, so components stream through one task, in order, a compact row
    each; what the task holds is a matrix of splits by features. Counting and ordering are distributed."""
    if set(fractions) != set(SPLITS) or min(fractions.values()) <= 0 or abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError(f"fractions must be positive for {SPLITS} and sum to 1")
    totals = {r["feature"]: float(r["v"]) for r in features.groupBy("feature").agg(F.sum("value").alias("v")).orderBy("feature").collect()}  # the catalogue of features
    names = list(totals)
    place = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))]) if names else F.lit(None)
    counts = features.groupBy(component).agg(
        F.max(F.when(F.col("feature") == "entities", F.col("value"))).alias("e"), F.max(F.when(F.col("feature") == "observations", F.col("value"))).alias("o"),
        F.collect_list(F.element_at(place, F.col("feature"))).alias("at"), F.collect_list(F.col("value").cast("double")).alias("v"),
    ) if names else features.select(component).distinct().selectExpr(component, "0 e", "0 o", "cast(array() as array<int>) at", "cast(array() as array<double>) v")
    share = np.array([fractions[s] for s in SPLITS])
    goal = np.maximum(share[:, None] * np.array([totals[n] for n in names])[None, :], 1.0) if names else np.ones((3, 0))
    weight = np.array([feature_weight(n) for n in names])

    def rank(c, split: str) -> int:
        return int.from_bytes(hashlib.sha256(f"{seed}:{c}:{split}".encode()).digest()[:8], "big")

    def run(batches):
        have, first = np.zeros_like(goal), True
        for pdf in batches:
            out = []
            for c, at, v in zip(pdf[component], pdf["at"], pdf["v"]):
                at, v = np.asarray(at, np.int64), np.asarray(v, float)
                # (gap + v) ** 2 - gap ** 2 = v * (2 * gap + v)
                error = (weight[at] * v * (2 * (have[:, at] - goal[:, at]) + v) / goal[:, at]).sum(1)
                error = np.round(error, 9)
                near = np.flatnonzero(error == error.min())
                k = 0 if first else int(min(near, key=lambda k: rank(c, SPLITS[k])))
                have[k, at] += v
                first = False
                out.append((c, SPLITS[k]))
            yield pd.DataFrame(out, columns=[component, "split"])

    kind = features.schema[component].dataType.simpleString()
    ordered = counts.orderBy(F.desc_nulls_last("e"), F.desc_nulls_last("o"), component).select(component, "at", "v")
    return ordered.coalesce(1).mapInPandas(run, f"{component} {kind}, split string")


def split_totals(features: DataFrame, assigned: DataFrame, component: str = "component") -> DataFrame:
    return features.join(assigned, component).groupBy("split", "feature").agg(F.sum("value").alias("value"))


def cross_pairs(entities: DataFrame) -> DataFrame:
    """The number of unordered pairs in different splits: (N ** 2 - sum of squares) / 2."""
    n = entities.groupBy("split").agg(F.count("*").alias("k"))
    return n.agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).cast("long").alias("cross_pairs"))


def cross_edges(edges: DataFrame, entities: DataFrame, idx: str = "entity_idx") -> DataFrame:
    """Edges with the splits of their ends, where these differ."""
    a = entities.select(F.col(idx).alias("i"), F.col("split").alias("first_split"))
    b = entities.select(F.col(idx).alias("j"), F.col("split").alias("second_split"))
    return edges.join(a, "i").join(b, "j").where("first_split <> second_split")


def validate(edges: DataFrame, entities: DataFrame, threshold: float = 0.30, idx: str = "entity_idx") -> DataFrame:
    """violations, max_cross_identity, cross_pairs, entities, repeated: one row; a valid split has no violations and no repeats."""
    x = cross_edges(edges, entities, idx).agg(F.count_if(F.col("si") >= threshold).alias("violations"), F.max("si").alias("max_cross_identity"))
    e = entities.agg(F.count("*").alias("entities"), (F.count("*") - F.count_distinct(idx)).alias("repeated"))
    return x.crossJoin(cross_pairs(entities)).crossJoin(e)  # single rows


def closest_cross(edges: DataFrame, entities: DataFrame, limit: int = 1000, idx: str = "entity_idx") -> DataFrame:
    return cross_edges(edges, entities, idx).orderBy(F.desc("si"), F.desc("i"), F.desc("j")).limit(limit)
