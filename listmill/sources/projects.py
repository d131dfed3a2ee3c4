"""Project dimension and end dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.schemas import PROJECT_CSV


def any_date(text: Column) -> Column:
    """Month/day/year or ISO text to DATE; anything else, such as NULL, is null."""
    return F.coalesce(F.try_to_date(text, "M/d/yyyy"), F.try_to_date(text, "yyyy-MM-dd"))


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Project CSV to ``alias, status, end_date``; the last row of an alias counts."""
    rows = spark.read.schema(PROJECT_CSV).option("header", True).csv(path)
    placed = rows.select(
        F.col("pj_alias").alias("alias"),
        "status",
        any_date(F.col("end_date")).alias("end_date"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("id"),
        ).alias("place"),
    )
    last = placed.groupBy("alias").agg(F.max_by(F.struct("status", "end_date"), "place").alias("last"))
    return last.select("alias", "last.status", "last.end_date")


def read_end_dates(spark: SparkSession, path: str) -> DataFrame:
    """JSON object of alias to date text, as ``alias, end_date``."""
    entries = F.explode(F.from_json("value", "map<string,string>"))
    return (
        spark.read.text(path, wholetext=True)
        .select(entries.alias("alias", "text"))
        .select("alias", any_date(F.col("text")).alias("end_date"))
    )
