"""Sharding by histogram sort.

The sort key is (hash of the text, doc_id) as 32 hexadecimal digits, so equal texts lie side by side
and a group of copies is split only where a shard ends inside it. Probes are key prefixes: exact
bytes and rows below every prefix are counted over all partitions, and cells that hold a splitter
and more than the tolerance, or too many rows for one task, are probed again with longer prefixes.
When all splitters are met, rows are exchanged once, by cell ranges of bounded row counts; a row's
slot is the count of rows before its range plus its rank in it.

Defined cases: a null text has no bytes (size 1, crc32 of nothing); a null doc_id sorts as the
smallest; rows that repeat text and doc_id are one key and take neighbouring slots; an empty table
gives no rows; other columns play no part.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.plans.scratch import Scratch

DIGITS = 32
TOLERANCE = 0.001  # of a shard's bytes
RANGES, MOST_RANGES = 512, 4096  # ranges of rows that are ranked in one task; their number follows the rows
LEAST_ROWS, RANGE_ROWS = 64, 500_000


def range_rows(n: int) -> int:
    """Rows of a range at most: RANGE_ROWS, unless there are few ranges or very many."""
    return max(LEAST_ROWS, n // min(MOST_RANGES, max(RANGES, n // RANGE_ROWS)))


def sort_key(text_col: str, id_col: str):
    high = F.lpad(F.hex(F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), 16, "0")
    low = F.lpad(F.hex(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(high, low)


def probe(keys: DataFrame, n_shards: int) -> tuple[list[tuple[str, int, int]], int]:
    """Cells (prefix, bytes, rows) in key order that cut the key space finely enough; total bytes.
    On the driver: 4096 first cells and 256 for each cell probed again, of which there are at most
    MOST_RANGES + n_shards at a depth."""
    total = keys.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total["n"]:
        return [], 0
    tolerance = total["b"] / n_shards * TOLERANCE
    most = range_rows(total["n"])
    depth, done, again = 3, [], None
    while True:
        part = keys if again is None else keys.where(F.substring("key", 1, before).isin([p for p, _ in again]))
        got = {r["p"]: (r["b"], r["n"]) for r in part.groupBy(F.substring("key", 1, depth).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
        start = {"": 0} if again is None else dict(again)
        run, now, parent = 0, [], None
        for p in sorted(got):
            own = "" if again is None else p[:before]
            if own != parent:
                parent, run = own, start[own]
            b, n = got[p]
            splits = any(run < total["b"] * j / n_shards < run + b for j in range(1, n_shards))
            if depth < DIGITS and (n > most or splits and b > tolerance and n > 1):
                now.append((p, run))
            else:
                done.append((p, b, n))
            run += b
        if not now:
            return sorted(done, key=lambda c: c[0].ljust(DIGITS, "0")), total["b"]
        again, before, depth = now, depth, min(DIGITS, depth + 2)


def shard(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: consecutive key ranges of near equal bytes."""
    spark = docs.sparkSession
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), sort_key(text_col, id_col).alias("key"))
    rows = Scratch(spark).write(rows, "keys")
    cells, total = probe(rows.select("key", "size"), n_shards)
    n_rows = sum(c[2] for c in cells)
    most = range_rows(n_rows)
    plan, at, shards, used = [], 0, 0, 0
    ranges = 0
    base = in_range = 0
    for p, b, n in cells:
        # a cell goes to the shard in which its middle lies
        own = min(n_shards - 1, int((at + b / 2) * n_shards // total))
        if own != shards:
            shards, used, ranges, in_range, base = own, 0, ranges + 1, 0, 0
        elif in_range and in_range + n > most:
            ranges, base, in_range = ranges + 1, used, 0
        plan.append((p, own, ranges, base))
        at, used, in_range = at + b, used + n, in_range + n
    depths = list(accumulate([3] + [2] * 15, lambda a, b: min(DIGITS, a + b)))
    lengths = sorted({len(p) for p, *_ in plan})
    known = F.broadcast(spark.createDataFrame(plan, "cell string, shard int, part long, base long"))
    out = None
    inner = {k: sorted({p[:k] for p, *_ in plan if len(p) > k}) for k in lengths}
    for k in [d for d in depths if d in lengths]:
        here = F.substring("key", 1, k)
        cell = here if out is None else cell
        out = (F.when(~here.isin(inner[k]), here) if inner[k] else F.when(F.lit(True), here)) if out is None else out.when(~here.isin(inner[k]) if inner[k] else F.lit(True), here)
    placed = rows.withColumn("cell", out if out is not None else F.lit("")).join(known, "cell")
    rank = F.row_number().over(W.partitionBy("part").orderBy("key"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + rank - 1).alias("slot"))


def op7_sharding(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return shard(docs).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
