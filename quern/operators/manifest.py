"""Observation and entity tables: union with provenance, checks, numbering, matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix import number_by_hash

OBSERVATION = ["observation_id", "sequence_sha256", "source_dataset", "endpoint", "target_kind", "target_value", "sequence"]


def union_observations(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by name; duplicates are kept."""
    out = parts[0].select(*OBSERVATION)
    for p in parts[1:]:
        out = out.unionByName(p.select(*OBSERVATION))
    return out


def entities(obs: DataFrame) -> DataFrame:
    """entity_idx, entity_id, sequence_sha256, sequence, length: one row for each hash, in hash order."""
    e = obs.groupBy("sequence_sha256").agg(F.first("sequence").alias("sequence"))
    e = number_by_hash(e, "sequence_sha256", "entity_idx")
    return e.select("entity_idx", F.format_string("entity:%06d", F.col("entity_idx") + 1).alias("entity_id"), "sequence_sha256", "sequence", F.length("sequence").cast("long").alias("length"))


def hash_violations(obs: DataFrame, hashed: Column) -> DataFrame:
    """Keys whose hash is not that of their sequence, or that name two sequences: rows (sequence_sha256, kind)."""
    wrong = obs.where(hashed != F.col("sequence_sha256")).select("sequence_sha256", F.lit("hash").alias("kind"))
    two = obs.groupBy("sequence_sha256").agg(F.min("sequence").alias("a"), F.max("sequence").alias("b")).where("a <> b").select("sequence_sha256", F.lit("sequence").alias("kind"))
    return wrong.union(two)


def decode_header(header: Column) -> tuple[Column, Column]:
    """(name, label) of `name A-0` or `name A-1`, split at the last white space; anything else is an error."""
    ok = header.rlike(r"^.*\s+A-[01]\s*$")
    checked = F.when(ok, header).otherwise(F.raise_error(F.concat(F.lit("bad header: "), header)))
    return F.regexp_extract(checked, r"^(.*?)\s+A-[01]\s*$", 1), F.regexp_extract(checked, r"\s+A-([01])\s*$", 1)


def require_empty(df: DataFrame, what: str) -> None:
    """Raises with a first row where a constraint's violations are not empty."""
    bad = df.limit(1).collect()
    if bad:
        raise ValueError(f"{what}: {bad[0].asDict()}")


def checked_join(left: DataFrame, right: DataFrame, on: str, check: bool = True) -> DataFrame:
    """Inner join in which a key of the left without partner is an error."""
    if check:
        require_empty(left.join(right, on, "left_anti").select(on), f"no {on} for")
    return left.join(right, on)


def preferred_match(left: DataFrame, right: DataFrame, on: str, preferred: str, name: str) -> DataFrame:
    """Left rows with the best of their matches (preferred first, then by name), all names and their number."""
    m = right.groupBy(on).agg(
        F.min(F.struct((~F.col(preferred)).alias("p"), F.col(name).alias("n"))).getField("n").alias("best"),
        F.array_join(F.sort_array(F.collect_set(name)), ";").alias("all_matches"), F.count_distinct(name).alias("match_count"),
    )
    out = left.join(m, on, "left")
    return out.withColumns({"best": F.coalesce("best", F.lit("")), "all_matches": F.coalesce("all_matches", F.lit("")), "match_count": F.coalesce("match_count", F.lit(0)).cast("long")})


def overlaps(obs: DataFrame) -> DataFrame:
    """sources, entities, conflicting: entities by the set of sources that hold them, and how many have two labels of one kind."""
    per = obs.groupBy("sequence_sha256").agg(F.array_join(F.sort_array(F.collect_set("source_dataset")), ";").alias("sources"))
    labels = obs.groupBy("sequence_sha256", "endpoint").agg(F.count_distinct("target_value").alias("k")).groupBy("sequence_sha256").agg(F.max("k").alias("k"))
    return per.join(labels, "sequence_sha256").groupBy("sources").agg(F.count("*").alias("entities"), F.count_if(F.col("k") > 1).alias("conflicting"))
