"""Per-list tables to the two deliverables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from listmill.schemas import COMMIT_EXPORT, COMMITS, EMAIL_EXPORT, MESSAGES
from listmill.sources.tables import read_list_tables, write_export


def run(spark: SparkSession, tables: str, target: str) -> None:
    """Union all lists, keep nine columns each and write CSV; no exchange."""
    commits = read_list_tables(spark, f"{tables}/commits", COMMITS, COMMIT_EXPORT)
    emails = read_list_tables(spark, f"{tables}/messages", MESSAGES, EMAIL_EXPORT)
    write_export(commits, f"{target}/commits")
    write_export(emails, f"{target}/emails")
