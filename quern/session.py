"""SparkSession defaults: UTC, Arrow, AQE; partition counts follow the master's cores in local runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "quern", cpus: int | None = None) -> SparkSession:
    """A local session for tests and benches; on a cluster the running session is reused."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.bindAddress", "127.0.0.1").config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
