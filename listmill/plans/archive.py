"""Archives to the commits, messages and rejects tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from listmill.operators import messages, rows
from listmill.operators.projects import with_project
from listmill.sources.archives import NOT_PARSED, read_archives, records_to_mails, scan_with_nested
from listmill.sources.tables import write_list_tables


def read_with_nested(spark: SparkSession, root: str, nested_root: str) -> DataFrame:
    """Mails of an archive tree and of nested directories; a nested file replaces its like.

    Decided per file, when files are listed: mails meet no join.
    """
    return records_to_mails(scan_with_nested(spark, root, nested_root, NOT_PARSED))


def parse(
    mails: DataFrame, projects: DataFrame, strict: bool = False, with_content: bool = False
) -> DataFrame:
    """Mails to parsed messages with status and period; one exchange, on the message key."""
    return (
        mails.transform(messages.parse_mails, strict, with_content)
        .transform(messages.first_copies)
        .transform(with_project, projects)
    )


def run(
    spark: SparkSession,
    root: str,
    projects: DataFrame,
    target: str,
    strict: bool = False,
    with_content: bool = False,
    nested_root: str | None = None,
) -> dict[str, int]:
    """Parse an archive tree once and write all tables under ``target``.

    The dimension is written and read back, so that Spark knows its size when it picks
    the join. The parsed messages are written next; the tables are cut from that narrow
    copy. Returns the counts of the run: all messages, those in each table, and the rest by
    reason; the parts add up to ``messages``.
    """
    projects.write.mode("overwrite").parquet(f"{target}/projects")
    dimension = spark.read.schema(projects.schema).parquet(f"{target}/projects")
    mails = read_with_nested(spark, root, nested_root) if nested_root else read_archives(spark, root)
    counts = Observation("parse")
    parsed = parse(mails, dimension, strict, with_content).observe(
        counts,
        F.count(F.lit(1)).alias("messages"),
        F.count_if(F.col("reject_reason") == "bad_date").alias("ignored"),
        F.count_if(F.col("reject_reason") == "unclassified").alias("unclassified"),
        F.count_if(F.col("reject_reason") == "empty_body").alias("empty"),
        F.count_if(F.col("reject_reason") == "no_changes").alias("no_changes"),
        F.count_if(F.col("reject_reason").isNull() & (F.col("msg_format") != "EMAIL")).alias("notices"),
        F.count_if(F.col("reject_reason").isNull() & (F.col("msg_format") == "EMAIL")).alias("emails"),
    )
    parsed.write.mode("overwrite").parquet(f"{target}/parsed")
    stored = spark.read.schema(parsed.schema).parquet(f"{target}/parsed")
    write_list_tables(rows.commit_rows(stored, ["proj_dir", "message_ts", "change_no"]), f"{target}/commits")
    write_list_tables(rows.email_rows(stored, ["proj_dir", "message_ts"]), f"{target}/messages")
    rows.reject_rows(stored).write.mode("overwrite").parquet(f"{target}/rejects")
    return counts.get
