"""Session defaults for local runs; a cluster's own session needs none of this."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(app: str, cpus: int | None = None, partitions: int = 8) -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def share_library(spark: SparkSession) -> None:
    """Let Python workers find this library where it is run from its folder and not installed."""
    home, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([home, *known])
