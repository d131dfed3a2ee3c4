"""Archive trees ``<project>/<folder>/<month>.mbox``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.functions.text import strip_non_ascii

# A message starts at each line that begins with this word.
RECORD_BREAK = "\nFrom "

# Directories that are not projects (fixed values).
NOT_CLEANED = ["asf-wide", "incubator"]
NOT_PARSED = ["asf-wide", "incubator", "attic"]

# <project>/<folder>/<file>, or the same as partition folders that hold part files.
_PLAIN = r"([^/]+)/([^/]+)/([^/]+)$"
_PARTITIONED = r"/project=([^/]+)/folder=([^/]+)/mbox=([^/]+)/[^/]+$"


def path_key(path: Column, part: int) -> Column:
    """Part 1, 2 or 3 of an encoded file path: project, folder, mbox.

    The names of partition folders are escaped once more than those of plain ones.
    """
    found = F.regexp_extract(path, _PARTITIONED, part)
    plain = F.regexp_extract(path, _PLAIN, part)
    return F.when(found != "", _decoded(_decoded(found))).otherwise(_decoded(plain))


def _decoded(name: Column) -> Column:
    return F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def keep_projects(files: DataFrame, excluded: list[str], directory: str = "proj_dir") -> DataFrame:
    return files.filter(~F.col(directory).isin(excluded))


def nested_key(path: Column, part: int) -> Column:
    """Key part of a file below a nested directory ``<project>-<folder>``; the last hyphen parts.

    '' for the project where the directory's name has no hyphen.
    """
    if part == 3:
        return path_key(path, 3)
    return F.regexp_extract(path_key(path, 2), "^(.*)-([^-]*)$", part)


def scan_records(reader, root: str, excluded: list[str], key=path_key, replaced: list[str] | None = None) -> DataFrame:
    """One row per record of every file under ``root``.

    ``key`` reads project, folder and mbox off a path; files without a project are left out.
    ``replaced`` names files, as ``project/folder/mbox``, that are left out as well.

    ``reader`` is ``spark.read`` or ``spark.readStream``. Files are split like any text
    file. The directory filter reads file metadata only, so excluded files are dropped
    when files are listed. ``value`` keeps the rest of the envelope line first.
    """
    path = F.col("_metadata.file_path")
    keep = ~key(path, 1).isin(["", *excluded])
    if replaced:
        keep &= ~F.concat_ws("/", key(path, 1), key(path, 2), key(path, 3)).isin(replaced)
    return (
        reader.option("recursiveFileLookup", True)
        .option("lineSep", RECORD_BREAK)
        .text(root)
        .filter(keep)
        .select(
            key(path, 1).alias("proj_dir"),
            key(path, 2).alias("folder"),
            key(path, 3).alias("mbox"),
            path.alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            "value",
        )
    )


def records_to_mails(records: DataFrame) -> DataFrame:
    """Number the records, clean the text and drop the envelope line.

    Ids grow along a split; the start of the split orders the splits of one file.
    """
    clean = records.withColumn("value", strip_non_ascii(F.col("value")))
    rest = F.substr("value", F.locate("\n", "value") + 1)
    return clean.select(
        "proj_dir",
        "folder",
        "mbox",
        "file_path",
        "block_start",
        F.monotonically_increasing_id().alias("seq"),
        F.when(F.contains("value", F.lit("\n")), rest).otherwise("").alias("raw"),
    )


def read_archives(spark: SparkSession, root: str, excluded: list[str] = NOT_PARSED) -> DataFrame:
    """Mails of an archive tree, in the ``MAIL`` schema."""
    return records_to_mails(scan_records(spark.read, root, excluded))


def nested_files(spark: SparkSession, nested_root: str, excluded: list[str]) -> list[str]:
    """Files that nested directories bring, as ``project/folder/mbox``.

    Names only, from a listing; the driver lists every file of a scan in any case.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(nested_root)
    path = F.col("_metadata.file_path")
    named = files.filter(~nested_key(path, 1).isin(["", *excluded])).select(
        F.concat_ws("/", *[nested_key(path, part) for part in (1, 2, 3)]).alias("name"))
    return sorted(row["name"] for row in named.distinct().collect())


def scan_with_nested(spark: SparkSession, root: str, nested_root: str, excluded: list[str]) -> DataFrame:
    """Records of a tree and of its nested directories; a nested file replaces its like.

    Which files count is settled from their names when files are listed: replaced files,
    nested directories without a hyphen and those of excluded projects are never read.
    """
    replaced = nested_files(spark, nested_root, excluded)
    base = scan_records(spark.read, root, excluded, replaced=replaced)
    return base.unionByName(scan_records(spark.read, nested_root, excluded, key=nested_key))


def existing_files(spark: SparkSession, root: str) -> DataFrame:
    """Keys of the files of an archive tree; the listing alone, no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.col("_metadata.file_path")
    return files.select(
        path_key(path, 1).alias("project"),
        path_key(path, 2).alias("folder"),
        path_key(path, 3).alias("filename"),
    )


def write_mbox(mails: DataFrame, root: str) -> None:
    """Write ``value`` texts (envelope rest first) as archive files, one folder per mbox.

    The rebalance lets adaptive execution cut a large mbox into several files and merge
    small ones, so neither one task nor a flood of files results.
    """
    (
        mails.select("proj_dir", "folder", "mbox", "value")
        .hint("rebalance", "proj_dir", "folder", "mbox")
        .transform(_as_archive)
        .write.partitionBy("project", "folder", "mbox")
        .text(root)
    )


def clean_archives(spark: SparkSession, source: str, target: str, nested_root: str | None = None) -> None:
    """Copy an archive tree without the bytes above 0x7F; nested directories under their own keys.

    No shuffle: a task writes what it reads. The sort keeps the order inside each file.
    """
    if nested_root:
        records = scan_with_nested(spark, source, nested_root, NOT_CLEANED)
    else:
        records = scan_records(spark.read, source, NOT_CLEANED)
    (
        records.withColumn("seq", F.monotonically_increasing_id())
        .withColumn("value", strip_non_ascii(F.col("value")))
        .sortWithinPartitions("proj_dir", "folder", "mbox", "file_path", "block_start", "seq")
        .transform(_as_archive)
        .write.partitionBy("project", "folder", "mbox")
        .text(target)
    )


def _as_archive(records: DataFrame) -> DataFrame:
    envelope_first = F.regexp_replace("value", "^From ", "")
    return records.select(
        F.col("proj_dir").alias("project"),
        "folder",
        "mbox",
        F.concat(F.lit("From "), envelope_first).alias("value"),
    )
