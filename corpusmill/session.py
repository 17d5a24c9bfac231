"""The session that scripts and tests of this repository use; on a cluster, pass your own instead."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "corpusmill", cores: int | None = None, memory: str = "8g") -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
