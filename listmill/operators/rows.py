"""Rows of the commits, messages and rejects tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listmill.schemas import COMMITS, MESSAGES, names

SOURCE = "ASF"


def commit_rows(messages: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per file change of SVN and Git notices.

    ``extra`` adds columns, such as ``change_no``, the place of the change in its mail.
    """
    kept = messages.filter(
        F.col("reject_reason").isNull() & F.col("msg_format").isin("SVN", "Git")
    ).drop("file_path")
    exploded = kept.select("*", F.posexplode("changes").alias("change_no", "change"))
    return exploded.select(
        "*",
        "change.*",
        F.col("author.name").alias("author_name"),
        F.col("author.email").alias("author_email"),
        F.col("committer.name").alias("committer_name"),
        F.col("committer.email").alias("committer_email"),
        F.lit(SOURCE).alias("source"),
    ).select(*names(COMMITS), *(extra or []))


def email_rows(messages: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row per plain mail."""
    kept = messages.filter(F.col("reject_reason").isNull() & (F.col("msg_format") == "EMAIL"))
    return kept.select(
        "*",
        F.col("author.name").alias("sender_name"),
        F.col("author.email").alias("sender_email"),
        F.lit(SOURCE).alias("source"),
    ).select(*names(MESSAGES), *(extra or []))


def reject_rows(messages: DataFrame) -> DataFrame:
    """Mails that went to neither table, with the reason."""
    return messages.filter(F.col("reject_reason").isNotNull()).select(
        "proj_name", "proj_dir", "folder", "mbox", "message_id", "reject_reason"
    )


def reject_counts(messages: DataFrame) -> DataFrame:
    return reject_rows(messages).groupBy("reject_reason").agg(F.count("*").alias("n"))
