"""Writers: fixed-order CSV, JSON lines, atomic JSON documents, sharded tables with completion markers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """Quotes are doubled and white space is kept, as readers.read_csv expects."""
    out = df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"')
    out.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """Sorted keys, indent 2, written beside the target and renamed, through Hadoop's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray((json.dumps(value, indent=2, sort_keys=True) + "\n").encode()))
        out.hsync()
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"cannot rename {part}")


def checksums(df: DataFrame, by: str) -> DataFrame:
    """(by, rows, checksum): an order-free sum of row hashes for each shard."""
    cols = sorted(c for c in df.columns if c != by)
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*cols).cast("decimal(20,0)")).cast("string").alias("checksum"))


def write_shards(df: DataFrame, path: str, shard: str) -> None:
    """The table by shard, and a marker with rows and checksum of each shard beside it; only the shards in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(f"{path}/data")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/data")
    mine = df.select(shard).distinct()
    marks = checksums(written.join(mine, shard, "left_semi").select(df.columns), shard)
    marks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(f"{path}/markers")


def write_prefixed(df: DataFrame, path: str, key: str, digits: int = 2) -> None:
    """By the first digits of a hash key, so that lookups prune folders."""
    df.withColumn("hash_prefix", F.substring(key, 1, digits)).write.mode("overwrite").partitionBy("hash_prefix").parquet(path)
