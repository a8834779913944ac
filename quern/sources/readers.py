"""Readers: labelled CSV, FASTA, fixed-width structure files, split folders, JSON, directory listings, predictions.

Schemas are declared, never inferred; text columns are cast where they are used.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Three-letter to one-letter residue names.
THREE_TO_ONE = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text, by header; a byte-order mark before the first name is dropped."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    raw = raw.toDF(*[c.removeprefix("﻿") for c in raw.columns])
    missing = [c for c in columns if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no columns {missing}")
    return raw.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def parse_fasta(lines: Column, upper: bool = True, strict: bool = True) -> Column:
    """Array of (ordinal, header, sequence) of the text of a FASTA file. Blank lines are skipped, pieces
    joined; with strict a sequence before the first header is an error, else it is dropped."""
    clean = F.regexp_replace(F.regexp_replace(lines, "\r", ""), "(?m)^[ \t]+|[ \t]+$", "")
    parts = F.split(F.concat(F.lit("\n"), clean), "\n>")
    head = F.regexp_replace(F.get(parts, 0), "\\s", "")
    checked = F.when(head != "", F.raise_error(F.lit("sequence before a header"))).otherwise(parts) if strict else parts
    records = F.slice(checked, F.lit(2), F.greatest(F.size(checked) - 1, F.lit(0)))

    def record(x, i):
        header = F.trim(F.substring_index(x, "\n", 1))
        seq = F.regexp_replace(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 1, F.length(x)), "\\s", "")
        return F.struct((i + 1).alias("ordinal"), header.alias("header"), (F.upper(seq) if upper else seq).alias("sequence"))

    return F.transform(records, record)


def read_fasta(spark: SparkSession, path: str, upper: bool = True, strict: bool = True) -> DataFrame:
    """(path, ordinal, header, sequence); gzip by the file's ending. A file is one record of text, so
    cut very large collections into files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.explode(parse_fasta(F.col("value"), upper, strict)).alias("r")).select("path", "r.*")


def read_fasta_large(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """(header, sequence) of FASTA files of any size: a record is what lies between two '>' at a line's start, so files are splittable."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    seq = F.regexp_replace(F.substr(body, F.length(F.substring_index(body, "\n", 1)) + 1, F.length(body)), "\\s", "")
    return raw.select(F.trim(F.substring_index(body, "\n", 1)).alias("header"), (F.upper(seq) if upper else seq).alias("sequence"))


def parse_structure(df: DataFrame, by: list[str], line_no: str, line: str) -> DataFrame:
    """One row (pos, residue, plddt) for each CA atom of fixed-width ATOM lines: alternate location blank
    or A, consecutive rows of one residue once, the B-factor as confidence."""
    at = lambda a, n: F.substring(F.col(line), a, n)
    ca = df.where((at(1, 6) == "ATOM  ") & (F.trim(at(13, 4)) == "CA") & at(17, 1).isin(" ", "A"))
    name = F.create_map(*[F.lit(x) for kv in THREE_TO_ONE.items() for x in kv])
    ca = ca.select(*by, line_no, at(22, 6).alias("residue_id"), F.coalesce(name[at(18, 3)], F.lit("X")).alias("residue"), at(61, 6).try_cast("double").alias("plddt"))
    w = W.partitionBy(*by).orderBy(line_no)
    first = ca.withColumn("_p", F.lag("residue_id").over(w)).where("_p is null or _p <> residue_id")
    return first.withColumn("pos", F.row_number().over(w) - 1).select(*by, "pos", "residue", "plddt")


def read_splits(spark: SparkSession, files: dict[str, str], columns: list[str], key: str) -> DataFrame:
    """Several CSV files under one schema with their split's name; a key that occurs twice is an error."""
    df = None
    for split, path in files.items():
        part = read_csv(spark, path, columns).withColumn("split", F.lit(split))
        df = part if df is None else df.unionByName(part)
    twice = df.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{key} occurs twice: {twice[0][0]}")
    return df


def list_files(spark: SparkSession, path: str, pattern: str, glob: str = "*") -> DataFrame:
    """(path, key): files below a folder whose name matches, key the pattern's first group."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path")
    return found.withColumn("key", F.regexp_extract("path", pattern, 1)).where("key <> ''")


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON documents or lines; malformed ones give nulls, not errors."""
    r = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE")
    return (r.schema(schema) if schema else r).json(path)


def read_predictions(spark: SparkSession, *paths: str) -> DataFrame:
    """(run, entity_idx, target, score) of the first path that exists, the others being fallbacks: the
    column is `logits` where there is one, else `predictions`."""
    found = next((p for p in paths if exists(spark, p)), None)
    if found is None:
        raise FileNotFoundError(f"none of {list(paths)}")
    df = spark.read.parquet(found)
    score = "logits" if "logits" in df.columns else "predictions"
    return df.select("run", F.col("entity_idx").cast("long"), F.col("target").cast("double"), F.col(score).cast("double").alias("score"))


def npy_rows(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, name, row, vector) of the bytes of .npy and .npz files: a row for each index of the first
    axis, the rest flattened. name is the array's in an archive, else empty. A file is held whole by its
    task; pickled objects are refused."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            for k, raw in zip(pdf[key], pdf[content]):
                got = np.load(io.BytesIO(raw), allow_pickle=False)
                arrays = {n: got[n] for n in got.files} if isinstance(got, np.lib.npyio.NpzFile) else {"": got}
                for name, a in arrays.items():
                    a = np.atleast_1d(a)
                    if not len(a):
                        continue
                    flat = a.reshape(len(a), int(np.prod(a.shape[1:]))).astype(float)
                    yield pd.DataFrame({key: [k] * len(a), "name": name, "row": np.arange(len(a)), "vector": list(flat)})

    return files.select(key, content).mapInPandas(run, f"{key} {kind}, name string, row long, vector array<double>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """npy_rows of the files under a path, by their path."""
    return npy_rows(spark.read.format("binaryFile").load(path), "path", "content")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """(name, url, revision, sha256, licence) of a JSON-lines catalogue of sources; an entry without a
    name, a url or a 64-digit hash is an error."""
    c = read_json(spark, path, "name string, url string, revision string, sha256 string, licence string", lines=True)
    bad = c.where(~(F.coalesce(F.col("name") != "", F.lit(False)) & F.coalesce(F.col("url") != "", F.lit(False)) & F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)))).limit(1).collect()
    if bad:
        raise ValueError(f"incomplete source: {bad[0].asDict()}")
    return c
