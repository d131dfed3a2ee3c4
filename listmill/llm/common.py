"""Columns and helpers that several operators share.

Internal columns begin with ``_lm_``; that prefix is reserved, so any other extra column of
an input table may have any name.
"""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.scratch import shared_folder

#: What separates words, inside a character class.
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"
#: The same characters as text, for trimming.
BLANK_TEXT = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship_with_jobs(module: str) -> None:
    """Tasks get a module's functions with the job; executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def text_of(column: str) -> Column:
    """The text; a null one is empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII takes the built-in, which is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def hash_pair(*columns: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that together stand for a value."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(7), *columns)


def doc_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Identifies a row for joins: rows that agree in both are the same document.

    Neither is null: a null id is the largest one, so such documents come last.
    """
    return (
        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_lm_id"),
        F.xxhash64(text_of(text_col), F.col(id_col).isNull()).alias("_lm_text"),
    )


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder.

    Cuts the lineage: a lost executor costs no earlier step, and a later job sees the same
    rows in the same places.
    """
    spark = frame.sparkSession
    path = shared_folder(spark, f"llm-{purpose}")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows made on the driver (few, such as one per input partition) as a table."""
    parsed = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(parsed))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
