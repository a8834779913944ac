"""Registry of the engine's own queries: name -> builder, name -> oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "entity_manifest"


def query(oracle: str | None = None):
    """Registers a builder under its function's name (less "_query"), with the SQL of its rows where SQL can say them."""

    def put(f):
        name = f.__name__.removesuffix("_query")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# the modules register their queries as they are imported
from quern.plans import queries_files, queries_metrics, queries_relational, queries_sequence  # noqa: E402, F401
