"""A pipeline over the table documents: five stages, each written and read again as the next one's input.

1. language ID: documents without a language (`und`: a null text, or no letter) go, and those whose
   n-grams are not those of the languages learned (keyboard mash, encoded data, other languages).
2. line dedup: later occurrences of three-line windows go from the texts.
3. n-gram Jaccard join: one document, of the smallest doc_id, of each group of near copies stays.
4. mixing: sources are brought to temperature weights; every document stays, small sources repeat up
   to MAX_REPETITION times.
5. packing: the kept texts as pieces of sequences of at most 2048 tokens. A document that mixing
   repeated has pieces for each repeat.

Defined cases: where no language is labelled, stage 1 drops only texts without a letter, so null, empty and
letterless texts never reach the others; a null doc_id or source stays; different texts under one id are
different documents, equal ones copies; an empty table gives no rows; other columns pass through to the
last stage.

All but the last stage return the columns of documents, n_chars as the stage leaves the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.jaccard_join import keep_one
from quern.llm.language_id import keep_known
from quern.llm.line_dedup import dedup_lines
from quern.llm.mixing import mix_sources
from quern.llm.packing import pack
from quern.plans.scratch import Scratch

MAX_REPETITION = 1.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs, max_repetition=MAX_REPETITION)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("jaccard_join", jaccard_join), ("mixing", mixing), ("packing", packing)]

#: Language ID is a learned model, so SQL can't give the rows; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
