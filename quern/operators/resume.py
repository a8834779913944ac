"""Sharded, resumable work: validity of shards, what is pending, cover audits, immutable configuration."""

from __future__ import annotations

import hashlib
import json
import platform
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.scratch import Scratch
from quern.sources import sinks
from quern.sources.readers import exists


def valid_shards(data: DataFrame, markers: DataFrame, shard: str) -> DataFrame:
    """Shards whose rows and checksum are those of their marker."""
    now = sinks.checksums(data, shard)
    m = markers.select(F.col(shard).alias("_s"), F.col("rows").alias("_r"), F.col("checksum").alias("_c"))
    return now.join(m, (F.col(shard) == F.col("_s")) & (F.col("rows") == F.col("_r")) & (F.col("checksum") == F.col("_c"))).select(shard)


def pending(assigned: DataFrame, valid: DataFrame, shard: str) -> DataFrame:
    return assigned.join(valid, shard, "left_anti")


def require_complete(assigned: DataFrame, valid: DataFrame, shard: str) -> None:
    missing = pending(assigned, valid, shard).count()
    if missing:
        raise ValueError(f"{missing} shards are not valid yet")


def cover(log: DataFrame, units: DataFrame, unit: str, status: str = "status") -> DataFrame:
    """expected, covered, missing, extra, overlap: an exact cover has missing = extra = overlap = 0."""
    seen = log.where(F.col(status) == 1).groupBy(unit).agg(F.count("*").alias("k"))
    j = units.select(unit).distinct().withColumn("u", F.lit(1)).join(seen, unit, "full_outer")
    return j.agg(
        F.count("u").alias("expected"), F.count_if(F.col("u").isNotNull() & F.col("k").isNotNull()).alias("covered"), F.count_if(F.col("k").isNull()).alias("missing"),
        F.count_if(F.col("u").isNull()).alias("extra"), F.count_if(F.col("k") > 1).alias("overlap"),
    )


def config_hash(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()


def run_shards(spark: SparkSession, path: str, config: dict, assigned: list[int], compute: Callable[[list[int]], DataFrame], shard: str = "shard") -> DataFrame:
    """Computes the assigned shards that are not valid under path and returns all data. Another
    configuration than the one stored there is refused; a shard that fails its checksum is computed
    again, the others are not touched."""
    marker = f"{path}/config"
    if exists(spark, marker):
        if spark.read.text(marker, wholetext=True).first()[0].strip() != config_hash(config):
            raise ValueError("the stored configuration differs")
    else:
        spark.createDataFrame([(config_hash(config),)], "value string").coalesce(1).write.text(marker)
    todo = sorted(assigned)
    if exists(spark, f"{path}/markers"):
        ok = {r[0] for r in valid_shards(spark.read.parquet(f"{path}/data"), spark.read.parquet(f"{path}/markers"), shard).collect()}
        todo = [s for s in todo if s not in ok]
    if todo:
        new = Scratch(spark).write(compute(todo), "shards")
        sinks.write_shards(new, path, shard)
    return spark.read.parquet(f"{path}/data")


def reduce_when_complete(spark: SparkSession, path: str, assigned: list[int], reduce: Callable[[DataFrame], DataFrame], shard: str = "shard") -> DataFrame:
    """reduce over the data of run_shards, once every assigned shard is valid; an error before."""
    data = spark.read.parquet(f"{path}/data")
    units = spark.createDataFrame([(s,) for s in assigned], data.select(shard).schema)
    require_complete(units, valid_shards(data, spark.read.parquet(f"{path}/markers"), shard), shard)
    return reduce(data)


def start_run(spark: SparkSession, base: str, run: str, config: dict) -> str:
    """The folder of a run, with config.json and environment.json. A run that exists must have the same configuration."""
    path = f"{base}/run={run}"
    marker = f"{path}/config.json"
    if exists(spark, marker):
        stored = json.loads(spark.read.text(marker, wholetext=True).first()[0])
        if config_hash(stored) != config_hash(config):
            raise ValueError(f"run {run}: the stored configuration differs")
    else:
        sinks.write_json(spark, marker, config)
        sinks.write_json(spark, f"{path}/environment.json", {"spark": spark.version, "python": platform.python_version()})
    return path


def read_runs(spark: SparkSession, base: str, document: str) -> DataFrame:
    """(run, key, value): the entries of one JSON document (config, metrics, ...) of every run under base."""
    files = spark.read.text(f"{base}/run=*/{document}.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), "run=([^/]+)/", 1).alias("run"), "value")
    return files.select("run", F.explode(F.from_json("value", "map<string,string>")))
