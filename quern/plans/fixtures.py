"""Reference concepts over the given tables, as DataFrames and as common table expressions for the oracles.

Expressions in text are valid, and mean the same, in both dialects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# labelled texts: one row for each document with labels
OBS = "obs AS (SELECT d.doc_id, sha256(trim(d.text)) AS h, trim(d.text) AS seq, d.source, d.lang, length(trim(d.text)) AS n, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def obs(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.trim("text").alias("seq"), "source", "lang")
    j = docs.join(table(spark, d, "labels"), "doc_id")
    return j.select("doc_id", F.sha2("seq", 256).alias("h"), "seq", "source", "lang", F.length("seq").alias("n"), "quality", "toxic")


# observations in long form: an endpoint for each label
LONG = OBS + (
    ", long AS (SELECT doc_id, h, seq, source, n, 'quality' AS endpoint, quality AS y FROM obs UNION ALL SELECT doc_id, h, seq, source, n, 'toxic', toxic FROM obs)"
)


def long_obs(spark, d) -> DataFrame:
    o = obs(spark, d)
    return o.select("doc_id", "h", "seq", "source", "n", F.lit("quality").alias("endpoint"), F.col("quality").alias("y")).union(o.select("doc_id", "h", "seq", "source", "n", F.lit("toxic"), "toxic"))


# scores of four runs in (0, 1), with ties in r2; a continuous target beside the binary one
RUNS = {
    "r0": "((doc_id * 7919) % 1009) / 1009e0 * 6e-1 + quality * 25e-2 + 5e-2",
    "r1": "((n * 31) % 503) / 503e0 * 5e-1 + quality * 3e-1 + 1e-1",
    "r2": "((doc_id * 271) % 23) / 23e0 * 7e-1 + quality * 15e-2 + 1e-1",
    "r3": "((n * 17 + doc_id * 13) % 211) / 211e0 * 8e-1 + quality * 5e-2 + 5e-2",
}
CONTINUOUS = "((doc_id * 31) % 101) / 101e0 * 4e-1 + ((n * 7) % 13) / 13e0 * 3e-1 + quality * 2e-1"
PRED = OBS + ", pred AS (" + " UNION ALL ".join(f"SELECT '{r}' AS run, doc_id AS entity_idx, quality AS target, {CONTINUOUS} AS y, {e} AS score FROM obs" for r, e in RUNS.items()) + ")"


def preds(spark, d, runs=tuple(RUNS)) -> DataFrame:
    o = obs(spark, d)
    y = F.expr(CONTINUOUS).alias("y")
    scores = F.explode(F.array(*[F.struct(F.lit(r).alias("run"), F.expr(RUNS[r]).alias("score")) for r in runs])).alias("s")
    return o.select(F.col("doc_id").alias("entity_idx"), F.col("quality").alias("target"), y, scores).select("s.run", "entity_idx", "target", "y", "s.score")


# positions of an entity: the lines of an order, numbered in full
RES = (
    "res AS (SELECT l_orderkey AS entity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, "
    "l_quantity AS value, l_extendedprice AS price, l_discount AS rsa, l_suppkey AS other, substr('ACDEFGHIKLMNPQRSTVWY', CAST(l_partkey % 20 + 1 AS INTEGER), 1) AS token FROM lineitem)"
)


def residues(spark, d) -> DataFrame:
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("entity"), (F.row_number().over(w) - 1).cast("long").alias("pos"), F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("rsa"), F.col("l_suppkey").alias("other"), F.expr("substr('ACDEFGHIKLMNPQRSTVWY', CAST(l_partkey % 20 + 1 AS INTEGER), 1)").alias("token"),
    )


# short sequences: the distinct part names, upper-cased letters only, numbered by hash
SHORT = (
    "short AS (SELECT row_number() OVER (ORDER BY h) - 1 AS entity_idx, h AS sequence_sha256, s AS sequence, length(s) AS length, sources FROM "
    "(SELECT sha256(s) AS h, s, list_sort(list(DISTINCT p_type)) AS sources FROM (SELECT upper(replace(p_name, ' ', '')) AS s, p_type FROM part) GROUP BY s))"
)


def short(spark, d) -> DataFrame:
    from quern.operators.prefix import number_by_hash

    p = table(spark, d, "part").select(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"), "p_type")
    e = p.groupBy("sequence").agg(F.sort_array(F.collect_set("p_type")).alias("sources")).withColumn("sequence_sha256", F.sha2("sequence", 256))
    return number_by_hash(e, "sequence_sha256", "entity_idx").select("entity_idx", "sequence_sha256", "sequence", F.length("sequence").cast("long").alias("length"), "sources")


# identities of all pairs of short sequences, by row-wise dynamic programming
LCS = SHORT + """,
pr AS (SELECT a.entity_idx AS i, b.entity_idx AS j, a.sequence AS x, b.sequence AS y FROM short a JOIN short b ON a.entity_idx < b.entity_idx),
dp AS (SELECT i, j, x, y, 0 AS step, list_transform(range(0, length(y) + 1), lambda k: 0::BIGINT) AS p FROM pr
  UNION ALL SELECT i, j, x, y, step + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(y) + 1), lambda k: [k])), lambda acc, e:
    list_append(acc, CASE WHEN substr(x, (step + 1)::INT, 1) = substr(y, e[1]::INT, 1) THEN p[e[1]] + 1 ELSE greatest(p[e[1] + 1], acc[e[1]]) END)) FROM dp WHERE step < length(x)),
si AS (SELECT i, j, p[len(p)] / (length(x) + length(y) - p[len(p)]) AS si FROM dp WHERE step = length(x))"""
