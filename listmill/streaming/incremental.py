"""Incremental ingestion: every file once, every Message-ID of a project once.

Three streams, all on Spark's own aggregates. The first parses each batch of new files and
writes its rows (the first copy of each id within the batch) to a folder of that batch. The
second reads those folders as narrow rows (id and place) and keeps, per id, the place of the
copy that comes first by list, month and place in Spark's keyed state (RocksDB store): a
minimum. A batch looks up only the ids it holds, whatever the history; an id whose minimum
lies in the batch's own parse folders is kept, its row read from those folders and written to
a folder of the batch, so that a batch that is run again replaces what it wrote. The third
reads the kept rows the same way and gathers an id's kept copies, each of which comes before
the one kept earlier: all but the first are written as retracted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listmill.operators import messages, rows
from listmill.operators.projects import with_project
from listmill.sources.archives import NOT_PARSED, records_to_mails, scan_records

_ID = ["proj_dir", "message_id"]
#: The order in which copies of an id are ranked, as in ``messages.first_copies``.
_ORDER = ["folder", "mbox", "file_path", "block_start", "seq"]
_COPY = [*_ORDER, "parsed_batch"]
_PLACE = ["file_path", "block_start", "seq", "parsed_batch"]
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Tables that each batch writes beside its kept rows, when a project table is given.
TABLES = ("commits", "messages", "rejects")


def _place() -> "F.Column":
    """One text for a copy's place; the tables carry it so that a replaced copy can leave them."""
    return F.concat_ws("|", *[F.col(c).cast("string") for c in _PLACE])


def _batch_tables(kept: DataFrame, projects: DataFrame) -> dict[str, DataFrame]:
    """The commits, messages and rejects rows of kept messages, each with its ``place``."""
    stored = kept.withColumn("place", _place()).transform(with_project, projects)
    rejects = rows.reject_rows(stored).columns
    return {
        "commits": rows.commit_rows(stored, ["place", "message_ts", "change_no"]),
        "messages": rows.email_rows(stored, ["place", "message_ts"]),
        "rejects": stored.filter(F.col("reject_reason").isNotNull()).select(*rejects, "place"),
    }


def _per_id(spark: SparkSession, folders: str, schema: StructType, copies: Column) -> DataFrame:
    """A stream of the ids in new files of ``folders``, each with an aggregate of all its ``copy`` structs so far."""
    places = spark.readStream.schema(schema).parquet(folders).select(*_ID, F.struct(*_COPY).alias("copy"))
    return places.groupBy(*_ID).agg(copies, F.max("copy.parsed_batch").alias("newest"))


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    (stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def ingest(
    spark: SparkSession,
    root: str,
    target: str,
    parse: Callable[[DataFrame], DataFrame],
    files_per_batch: int | None = None,
    projects: DataFrame | None = None,
) -> None:
    """Parse the files that are new under ``root`` and keep the first copy of every id.

    With ``projects``, each batch also writes its rows of the commits, messages and rejects
    tables (``table`` reads them), in folders of the batch like the kept rows.

    The first copy is the one first by list, month and place (file, offset, record), as in
    a run over all files at once, in whatever order the files arrive: a copy that arrives
    later but comes first replaces the one kept (``retracted`` lists what it replaces). Mail
    dates cannot be trusted, so there is no watermark; the state holds one row per id, with its
    first copy, and one with the copies that were kept in turn.
    ``files_per_batch`` cuts a long backlog into batches that are kept one by one.
    """
    def write_parsed(records: DataFrame, batch_id: int) -> None:
        fresh = messages.first_copies(parse(records_to_mails(records)))
        fresh.withColumn("parsed_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{target}/parsed/part{batch_id}")

    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    (scan_records(reader, root, NOT_PARSED).writeStream.foreachBatch(write_parsed)
     .option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    try:
        parsed_schema = spark.read.parquet(f"{target}/parsed/*").schema
    except Exception as e:  # no file was ever parsed: nothing to keep
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return
        raise

    def write_kept(ids: DataFrame, batch_id: int) -> None:
        session = ids.sparkSession
        # Written and read back, so that the state is asked once.
        ids.write.mode("overwrite").parquet(f"{target}/firsts/batch={batch_id}")
        ids = session.read.schema(ids.schema).parquet(f"{target}/firsts/batch={batch_id}")
        # Parse batches come in order: those up to the previous batch's mark were decided before.
        seen = session.read.parquet(f"{target}/marks/batch={batch_id - 1}").first()[0] if batch_id else -1
        keep = ids.where(F.col("first.parsed_batch") > seen).select("first.*")
        # The parse batches that this batch keeps rows of: a few names, not the rows.
        parts = [r[0] for r in keep.select("parsed_batch").distinct().collect()]
        if parts:
            source = session.read.schema(parsed_schema).parquet(*[f"{target}/parsed/part{p}" for p in parts])
            kept = source.join(keep.select(*_PLACE), _PLACE, "left_semi")
        else:
            kept = session.createDataFrame([], parsed_schema)
        kept.write.mode("overwrite").parquet(f"{target}/rows/batch={batch_id}")
        if projects is not None:
            # Read back, so that the tables are cut from the written copy and not parsed again.
            written = session.read.schema(kept.schema).parquet(f"{target}/rows/batch={batch_id}")
            for name, frame in _batch_tables(written, projects).items():
                frame.write.mode("overwrite").parquet(f"{target}/tables/{name}/batch={batch_id}")
        ids.agg(F.greatest(F.max("newest"), F.lit(seen).cast("long")).alias("newest")).write.mode("overwrite").parquet(
            f"{target}/marks/batch={batch_id}")

    def write_retracted(ids: DataFrame, batch_id: int) -> None:
        replaced = ids.select(*_ID, F.explode(F.array_remove("kept", F.array_min("kept"))).alias("copy"))
        replaced.select(*_ID, *[f"copy.{c}" for c in _PLACE]).write.mode("overwrite").parquet(
            f"{target}/retracted/batch={batch_id}")

    previous = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    try:
        firsts = _per_id(spark, f"{target}/parsed/*", parsed_schema, F.min("copy").alias("first"))
        _run(firsts, write_kept, f"{target}/checkpoint-ids")
        chains = _per_id(spark, f"{target}/rows/*", parsed_schema, F.collect_set("copy").alias("kept"))
        _run(chains, write_retracted, f"{target}/checkpoint-kept")
    finally:
        if previous is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", previous)


def ingest_messages(
    spark: SparkSession,
    root: str,
    target: str,
    strict: bool = False,
    files_per_batch: int | None = None,
    projects: DataFrame | None = None,
) -> None:
    """Incremental form of the parse step; with ``projects``, of the whole run."""
    ingest(spark, root, target, lambda mails: messages.parse_mails(mails, strict), files_per_batch, projects)


def stored(spark: SparkSession, target: str) -> DataFrame:
    """All rows kept so far and not replaced since; ``batch`` tells the run that kept them."""
    kept = spark.read.parquet(f"{target}/rows")
    retracted = _retracted(spark, target)
    if retracted is None:
        return kept.drop("parsed_batch")
    return kept.join(retracted, _PLACE, "left_anti").drop("parsed_batch")


def _retracted(spark: SparkSession, target: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{target}/retracted").select(*_PLACE)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def table(spark: SparkSession, target: str, name: str) -> DataFrame:
    """Rows of ``name`` (one of ``TABLES``) of all batches, without those of replaced copies."""
    found = spark.read.parquet(f"{target}/tables/{name}")
    gone = _retracted(spark, target)
    if gone is not None:
        found = found.join(gone.select(_place().alias("place")), "place", "left_anti")
    return found.drop("place", "batch")


def counts(spark: SparkSession, target: str) -> dict[str, int]:
    """Messages of the run so far: those in each table and the rejected ones by reason."""
    kept = stored(spark, target)
    found = kept.agg(
        F.count(F.lit(1)).alias("messages"),
        *[F.count_if(F.col("reject_reason") == r).alias(name) for name, r in (
            ("ignored", "bad_date"), ("unclassified", "unclassified"), ("empty", "empty_body"),
            ("no_changes", "no_changes"))],
        F.count_if(F.col("reject_reason").isNull() & (F.col("msg_format") != "EMAIL")).alias("notices"),
        F.count_if(F.col("reject_reason").isNull() & (F.col("msg_format") == "EMAIL")).alias("emails"),
    ).first()
    return found.asDict()
