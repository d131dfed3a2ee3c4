"""Project look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listmill.functions import dates, pages


def with_project(messages: DataFrame, projects: DataFrame) -> DataFrame:
    """Add status and period from ``projects(alias, status, end_date)``.

    An unknown project is incubating and has no period. The join carries no hint: Spark
    broadcasts the dimension while it is below ``autoBroadcastJoinThreshold`` and
    otherwise sorts and merges, with adaptive splitting of a hot project.
    """
    dim = projects.select(
        F.col("alias"), F.col("status").alias("known_status"), "end_date", F.lit(True).alias("known")
    )
    status = F.when(F.col("known"), F.col("known_status")).otherwise("incubating")
    return (
        messages.join(dim, F.col("proj_name") == F.col("alias"), "left")
        .withColumn("status", status)
        .withColumn("period", dates.period(F.col("message_ts"), F.col("end_date")))
        .drop("alias", "known_status", "end_date", "known")
    )


def with_attic_flag(projects: DataFrame, attic_ids: DataFrame) -> DataFrame:
    """Whether the project ``id`` is in ``attic_ids(id)``; ids may repeat there."""
    known = attic_ids.select("id").distinct().withColumn("listed", F.lit(True))
    return projects.join(known, "id", "left").withColumn(
        "in_attic", F.col("listed").isNotNull()
    ).drop("listed")


def dimension(catalogue: DataFrame) -> DataFrame:
    """Catalogue projects as the dimension that messages are joined with."""
    return catalogue.select(
        F.col("id").alias("alias"), pages.status_name(F.col("status")).alias("status"), "end_date"
    )
