"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Every three consecutive lines of a text make a window. Windows are hashed and grouped over all
documents; the first occurrence, by (doc_id, text hash, position), stays and the lines covered by
later occurrences go. Only slim window rows are shuffled for the search; a hot window is combined
before the shuffle and its join is one that AQE splits.

Defined cases: a null text stays null; texts of fewer than three lines, and windows of nothing but
spaces, are left alone; a later occurrence that overlaps its own first one loses only what lies
beyond it; rows that repeat a doc_id and text are judged alike; a null doc_id sorts first; a text
whose lines all go becomes empty and its row stays; extra columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, counts: bool = False) -> DataFrame:
    """docs with text_col rewritten. counts: also n_lines and n_removed (they replace columns so named)."""
    lines = F.split(text_col, "\n", -1)
    key = [F.col(id_col).alias("i"), F.xxhash64(text_col).alias("f")]

    def at(k):
        part = [F.get(F.col("l"), k + j) for j in range(window)]
        blank = F.length(F.trim(F.concat(*part))) == 0
        return F.when(~blank, F.struct(F.xxhash64(*part).alias("h"), F.xxhash64(F.lit("second"), *reversed(part)).alias("g")))

    split = docs.where(F.col(text_col).isNotNull()).select(*key, lines.alias("l")).where(F.size("l") >= window)
    windows = split.select("i", "f", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("l") - window), at)).alias("p", "w"))
    windows = windows.where("w is not null").select("i", "f", "p", "w.h", "w.g")
    firsts = (
        windows.groupBy("h", "g").agg(F.min(F.struct("i", "f", "p")).alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("h", "g", "first")
    )
    same = F.col("i").eqNullSafe(F.col("first.i")) & (F.col("f") == F.col("first.f"))
    start = F.when(same, F.greatest(F.col("p"), F.col("first.p") + window)).otherwise(F.col("p"))
    later = windows.join(firsts, ["h", "g"]).where(~(same & (F.col("p") == F.col("first.p"))))
    spans = later.select("i", "f", start.alias("s"), (F.col("p") + window - 1).alias("e")).where("s <= e")
    covered = spans.select("i", "f", F.explode(F.sequence("s", "e")).alias("k")).groupBy("i", "f").agg(F.collect_set("k").alias("gone"))

    rows = docs.select(F.struct("*").alias("row"), *key)
    c = covered.select(F.col("i").alias("ci"), F.col("f").alias("cf"), "gone")
    joined = rows.join(c, rows["i"].eqNullSafe(c["ci"]) & (rows["f"] == c["cf"]), "left")
    l = F.split(F.col("row")[text_col], "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.col("gone"))
    joined = joined.withColumn("l", F.when(F.col("gone").isNotNull(), l))
    text = F.when(F.col("gone").isNull(), F.col("row")[text_col]).otherwise(F.array_join(F.transform(left, lambda k: F.get(F.col("l"), k)), "\n"))
    out = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if not (counts and c in ("n_lines", "n_removed"))]
    if counts:
        out += [
            F.when(F.col("row")[text_col].isNull(), 0).otherwise(F.size(l)).cast("long").alias("n_lines"),
            F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        ]
    return joined.select(*out)


def op9_line_dedup(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, counts=True)


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM l WHERE len(ls) >= 3),
k AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win FROM w
      WHERE trim(ls[pos + 1] || ls[pos + 2] || ls[pos + 3]) <> ''),
o AS (SELECT doc_id, pos, first_value(doc_id) OVER v AS fd, first_value(pos) OVER v AS fp, row_number() OVER v AS rn
      FROM k WINDOW v AS (PARTITION BY win ORDER BY doc_id, pos)),
s AS (SELECT doc_id, CASE WHEN doc_id = fd THEN greatest(pos, fp + 3) ELSE pos END AS a, pos + 2 AS e FROM o WHERE rn > 1),
g AS (SELECT doc_id, list(DISTINCT j) AS gone FROM (SELECT doc_id, unnest(range(a, e + 1)) AS j FROM s WHERE a <= e) GROUP BY doc_id)
SELECT l.doc_id,
  CASE WHEN g.gone IS NULL THEN l.text ELSE coalesce(array_to_string(list_transform(
    list_filter(range(0, len(ls)), lambda i: NOT list_contains(g.gone, i)), lambda i: ls[i + 1]), chr(10)), '') END AS text,
  coalesce(len(ls), 0) AS n_lines, coalesce(len(g.gone), 0) AS n_removed
FROM l LEFT JOIN g ON l.doc_id = g.doc_id
"""
