"""Manifest of archive addresses: lines ``project,folder,url`` without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Only the first two commas part fields; an address may contain more."""
    parts = F.split("value", ",", 3)
    return spark.read.text(path).select(
        F.get(parts, 0).alias("project"),
        F.get(parts, 1).alias("folder"),
        F.get(parts, 2).alias("url"),
    )


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(F.concat_ws(",", "project", "folder", "url").alias("value")).write.text(path)
