"""Catalogue pages to projects, manifest and pending archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listmill.operators import catalogue, manifest
from listmill.sources import manifest as manifest_io
from listmill.sources.archives import existing_files
from listmill.sources.saved_pages import read_pages


def build_projects(spark: SparkSession, project_page: str, attic_page: str) -> DataFrame:
    return catalogue.projects(read_pages(spark, project_page), read_pages(spark, attic_page))


def build_manifest(
    spark: SparkSession, list_page: str, index_pages: DataFrame, target: str
) -> DataFrame:
    """Write the manifest of all lists and months and return it as read back."""
    lists = catalogue.list_rows(read_pages(spark, list_page))
    manifest_io.write_manifest(catalogue.manifest_rows(lists, index_pages), target)
    return manifest_io.read_manifest(spark, target)


def pending_archives(spark: SparkSession, manifest_path: str, root: str) -> DataFrame:
    return manifest.pending(manifest_io.read_manifest(spark, manifest_path), existing_files(spark, root))
