"""Manifest and key work: pending archives, re-keyed directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE_KEYS = ["project", "folder", "filename"]


def url_file_name(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def with_file_name(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("filename", url_file_name(F.col("url")))


def pending(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Manifest entries whose file is not among ``existing(project, folder, filename)``.

    The distinct shares its exchange with the join and folds repeated keys before it.
    """
    present = existing.select(*FILE_KEYS).distinct()
    return with_file_name(manifest).join(present, FILE_KEYS, "left_anti")


def progress(manifest: DataFrame, existing: DataFrame) -> DataFrame:
    """Total, completed and remaining entries."""
    present = existing.select(*FILE_KEYS).distinct().withColumn("present", F.lit(True))
    marked = with_file_name(manifest).join(present, FILE_KEYS, "left")
    return marked.agg(
        F.count("*").alias("total"),
        F.count("present").alias("completed"),
        F.count_if(F.col("present").isNull()).alias("remaining"),
    )


def drop_empty(downloads: DataFrame) -> DataFrame:
    """Downloads that brought some content."""
    return downloads.filter(F.length("content") > 0)


def split_nested(files: DataFrame) -> DataFrame:
    """Nested directories ``<project>-<folder>`` to project and folder.

    Keys without a hyphen are left out; with several, the last one parts.
    """
    parts = "^(.*)-([^-]*)$"
    return (
        files.filter(F.contains("nested_key", F.lit("-")))
        .withColumn("project", F.regexp_extract("nested_key", parts, 1))
        .withColumn("folder", F.regexp_extract("nested_key", parts, 2))
        .drop("nested_key")
    )


def overwrite_union(base: DataFrame, nested: DataFrame, keys: list[str] = FILE_KEYS) -> DataFrame:
    """Both file sets; where a key is in both, the nested copy stays."""
    return base.join(nested.select(*keys).distinct(), keys, "left_anti").unionByName(nested)
