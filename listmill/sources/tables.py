"""Per-list tables and the two deliverables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listmill.schemas import names

_CSV = {
    "header": True, "nullValue": "", "emptyValue": "", "escape": '"',
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}
# A quoted field may hold line breaks of any kind, so readers parse files, not lines.
_READ_CSV = _CSV | {"multiLine": True}


def write_list_tables(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One partition per project and list; empty ones do not come into being.

    The rebalance gathers a list's rows into few files and splits a list that is too
    large for one task.
    """
    writer = (
        rows.hint("rebalance", "proj_name", "folder")
        .write.mode("overwrite")
        .partitionBy("proj_name", "folder")
    )
    if fmt == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.format(fmt).save(path)


def read_list_tables(
    spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, fmt: str = "parquet"
) -> DataFrame:
    """All per-list tables under ``path`` as one, duplicates kept.

    Types come from the schema, never from the files. ``columns`` prunes the scan.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**_READ_CSV, enforceSchema=False)
    return reader.format(fmt).load(path).select(*(columns or names(schema)))


def write_export(rows: DataFrame, path: str) -> None:
    """CSV with a header and without an index; one file per task."""
    rows.write.mode("overwrite").options(**_CSV).csv(path)


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**_READ_CSV).csv(path)


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """A few rows to look at, in no order."""
    return rows.limit(n)
