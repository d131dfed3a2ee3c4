"""Session settings for local runs; a cluster brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    shuffles = str(os.cpu_count() if cpus == "*" else cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("listmill")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", shuffles)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
