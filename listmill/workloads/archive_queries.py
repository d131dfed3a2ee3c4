"""Whole-archive queries: scan, clean, parse, union, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.functions import text
from listmill.operators import messages, rows
from listmill.plans import archive
from listmill.schemas import COMMIT_EXPORT, COMMITS, EMAIL_EXPORT, MESSAGES
from listmill.scratch import shared_folder
from listmill.sources import archives, tables
from listmill.streaming import incremental
from listmill.workloads.mails import (
    ARCHIVE_SQL,
    CLEAN_SQL,
    doc_id,
    archive_of,
    line,
    mail,
    project_dimension,
    table,
    words,
)


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    mails = archives.keep_projects(archive_of(table(spark, sf, "documents")), archives.NOT_PARSED)
    return archive.parse(mails, project_dimension(table(spark, sf, "nation")))


def commits(spark: SparkSession, sf: str) -> DataFrame:
    return rows.commit_rows(_parsed(spark, sf))


def emails(spark: SparkSession, sf: str) -> DataFrame:
    return rows.email_rows(_parsed(spark, sf))


def reject_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rows.reject_counts(_parsed(spark, sf))


#: A made-up project beside all real ones that readers are told to leave out.
_SKIPPED = "skipped-copies"


def _document_tree(spark: SparkSession, sf: str, skipped: str | None = None) -> str:
    """Every document as a mail in an archive tree of text files.

    With ``skipped``, every document is there a second time under that project, so that a
    reader that leaves the project out is tested on all of them while all real sources stay.
    """
    root = shared_folder(spark, "mbox")
    value = words(
        "x@h Mon Feb  3 10:00:00 2003\n",
        mail(line("Message-ID", words(doc_id())), line("Subject", words("d", doc_id())), body=F.col("text")),
        "\n",
    )
    docs = table(spark, sf, "documents")
    if skipped:
        docs = docs.unionByName(docs.withColumn("source", F.lit(skipped)))
    archives.write_mbox(
        docs.select(
            F.col("source").alias("proj_dir"),
            F.when(doc_id() % 2 == 0, "dev").otherwise("commits").alias("folder"),
            words(doc_id() % 12, ".mbox").alias("mbox"),
            value.alias("value"),
        ),
        root,
    )
    return root


def mbox_scan(spark: SparkSession, sf: str) -> DataFrame:
    mails = archives.read_archives(spark, _document_tree(spark, sf, _SKIPPED), excluded=[_SKIPPED])
    found = mails.transform(messages.with_headers).transform(messages.with_message_id)
    return found.select(
        F.col("proj_dir").alias("project"),
        "folder",
        "mbox",
        "message_id",
        text.header(F.col("lines"), "subject").alias("subject"),
    )


def mbox_records(spark: SparkSession, sf: str) -> DataFrame:
    mails = archives.read_archives(spark, _document_tree(spark, sf, _SKIPPED), excluded=[_SKIPPED])
    has_id = text.header(F.col("lines"), "message-id").isNotNull()
    return (
        mails.transform(messages.with_headers)
        .groupBy(F.col("proj_dir").alias("project"))
        .agg(F.count("*").alias("n_records"), F.count_if(has_id).alias("n_mails"))
    )


def ascii_clean(spark: SparkSession, sf: str) -> DataFrame:
    target = shared_folder(spark, "ascii-mbox")
    archives.clean_archives(spark, _document_tree(spark, sf), target)
    records = archives.records_to_mails(archives.scan_records(spark.read, target, []))
    found = records.transform(messages.with_headers).transform(messages.with_message_id)
    body = text.after_header(F.col("raw"), F.col("head"))
    return found.select(
        F.col("message_id").cast("bigint").alias("doc_id"),
        F.rtrim(body, F.lit("\n")).alias("body"),
    )


def commits_union(spark: SparkSession, sf: str) -> DataFrame:
    """SVN and Git branches into per-list tables, read back together with nine columns."""
    every = commits(spark, sf)
    path = shared_folder(spark, "commits")
    svn, git = every.filter("msg_format = 'SVN'"), every.filter("msg_format = 'Git'")
    tables.write_list_tables(svn.unionByName(git), path)
    return tables.read_list_tables(spark, path, COMMITS, COMMIT_EXPORT)


def emails_union(spark: SparkSession, sf: str) -> DataFrame:
    """Per-list CSV tables, read back together, exported and read once more."""
    path, target = shared_folder(spark, "messages"), shared_folder(spark, "emails")
    tables.write_list_tables(emails(spark, sf), path, fmt="csv")
    tables.write_export(tables.read_list_tables(spark, path, MESSAGES, EMAIL_EXPORT, fmt="csv"), target)
    schema = (
        "proj_name string, mbox string, folder string, message_id string, period int, "
        "status string, reference_id string, message_date string, sender_name string"
    )
    return tables.read_export(spark, target, schema)


def _run_on_files(spark: SparkSession, sf: str) -> tuple[str, dict[str, int]]:
    """The whole job over an archive written as files: the tables' folder and the counts.

    Bodies are escaped as mail writers do, so that no line of a text begins a mail.
    """
    root, target = shared_folder(spark, "mbox"), shared_folder(spark, "tables")
    mails = archive_of(table(spark, sf, "documents"))
    escaped = F.regexp_replace("raw", r"\nFrom ", "\n>From ")
    archives.write_mbox(mails.withColumn("value", words("x@h Mon\n", escaped, "\n")), root)
    return target, archive.run(spark, root, project_dimension(table(spark, sf, "nation")), target)


def archive_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job from files to tables: every commit row and every mail, with their facts."""
    target, _ = _run_on_files(spark, sf)
    shared = ["proj_name", "mbox", "folder", "message_id", "period", "status", "message_date"]
    found = tables.read_list_tables(spark, f"{target}/commits", COMMITS)
    mailed = tables.read_list_tables(spark, f"{target}/messages", MESSAGES)
    return found.select(
        *shared, F.col("author_name").alias("who"), F.col("author_email").alias("address"),
        F.concat_ws(" ", "file_op", "file_path").alias("what"), "addlines", "dellines",
    ).unionByName(mailed.select(
        *shared, F.col("sender_name").alias("who"), F.col("sender_email").alias("address"), F.col("subject").alias("what"),
        F.lit(None).cast("int").alias("addlines"), F.lit(None).cast("int").alias("dellines")))


def run_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every message of a run is in one table or rejected for one reason: the counts by place."""
    parsed = _parsed(spark, sf)
    place = F.coalesce("reject_reason", F.when(F.col("msg_format") == "EMAIL", "emails").otherwise("notices"))
    return parsed.groupBy(place.alias("place")).agg(F.count("*").alias("n")).unionByName(
        parsed.groupBy(F.lit("messages").alias("place")).agg(F.count("*").alias("n")))


def nested_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Files of a tree and of nested directories that replace some of them (S11)."""
    root = shared_folder(spark, "nested-tree")
    value = words("x@h Mon\n", mail(line("Message-ID", words(doc_id())), body=F.lit("b")), "\n")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("p"), F.when(doc_id() % 3 == 0, "dev").otherwise("commits").alias("f"),
        words(doc_id() % 12, ".mbox").alias("mbox"), value.alias("value"))
    nested = (doc_id() % 4 == 1) & (doc_id() % 12 < 6)
    archives.write_mbox(rows.filter(~nested).withColumnsRenamed({"p": "proj_dir", "f": "folder"}), f"{root}/mbox")
    archives.write_mbox(rows.filter(nested).select(
        F.lit("incubator").alias("proj_dir"),
        F.when(doc_id() % 5 == 0, "general").otherwise(words(F.col("p"), "-", F.col("f"))).alias("folder"), "mbox", "value"), f"{root}/nested")
    mails = archive.read_with_nested(spark, f"{root}/mbox", f"{root}/nested")
    found = mails.transform(messages.with_headers).transform(messages.with_message_id)
    return found.select(F.col("message_id").cast("bigint").alias("doc_id"), "proj_dir", "folder", "mbox")


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with quotes, commas, backslashes and line breaks of all kinds through both CSV tables.

    Whole texts go along with a hash each; a row whose text comes back otherwise has no subject.
    """
    marks = F.array(*[F.lit(m) for m in ("\r", "\n", "\r\n", '"', ",", "\\", '\\"', "a\rb", "\r\r", '",\r"')])

    def odd(content):
        return words(F.col("source"), F.get(marks, (doc_id() % 10).cast("int")), content, F.get(marks, (doc_id() % 7).cast("int")), "z")

    texts = table(spark, sf, "documents").select(
        F.col("source").alias("proj_name"), F.col("lang").alias("folder"), odd(F.substring("text", 1, 40)).alias("subject"),
        odd(F.col("text")).alias("whole"), F.sha2(odd(F.col("text")), 256).alias("sha256"), F.col("doc_id").alias("n"))
    columns = "subject string, whole string, sha256 string, n bigint, proj_name string, folder string"
    path, target = shared_folder(spark, "csv"), shared_folder(spark, "csv-export")
    tables.write_list_tables(texts, path, fmt="csv")
    back = tables.read_list_tables(spark, path, columns, fmt="csv")
    tables.write_export(back, target)
    same = F.sha2("whole", 256) == F.col("sha256")
    return tables.read_export(spark, target, columns).select(F.when(same, F.col("subject")).alias("subject"), "n", "proj_name", "folder")


def incremental_mails(spark: SparkSession, sf: str) -> DataFrame:
    """Three drops of files, each followed by a stream run; then all mails that were kept.

    A copy that a later drop brings replaces the one kept if it comes first by list, month
    and place, the drop's folder being part of the place.
    """
    root, target = shared_folder(spark, "drops"), shared_folder(spark, "stream")
    mails = archive_of(table(spark, sf, "documents"))
    escaped = F.regexp_replace("raw", r"\nFrom ", "\n>From ")
    written = mails.withColumn("value", words("x@h Mon\n", escaped, "\n"))
    for drop in range(3):
        archives.write_mbox(written.filter(F.floor(F.col("seq") / 7) % 3 == drop), f"{root}/drop{drop}")
        incremental.ingest_messages(spark, f"{root}/*", target)
    return incremental.stored(spark, target).select(
        "proj_dir", "folder", "mbox", "message_id", "subject", "message_date", "reject_reason",
        F.coalesce(F.size("changes"), F.lit(0)).alias("n_changes"))


def _directory():
    return words("p", F.floor(doc_id() / 50) % 20)


def _key():
    return F.when(doc_id() % 10 == 9, doc_id() - 1).otherwise(doc_id())


def dedup_first(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "documents").select(
        "doc_id",
        _directory().alias("proj_dir"),
        words("<", _key(), "@h>").alias("message_id"),
        words("l", doc_id() % 3).alias("folder"),
        words("m", doc_id() % 12).alias("mbox"),
        F.lit("f").alias("file_path"),
        F.lit(0).alias("block_start"),
        doc_id().alias("seq"),
    )
    return messages.first_copies(named).select("doc_id", "proj_dir", "message_id", "folder", "mbox")


QUERIES = {
    "commits": commits,
    "emails": emails,
    "reject_summary": reject_summary,
    "mbox_scan": mbox_scan,
    "mbox_records": mbox_records,
    "ascii_clean": ascii_clean,
    "commits_union": commits_union,
    "emails_union": emails_union,
    "archive_run": archive_run,
    "run_counts": run_counts,
    "nested_archive": nested_archive,
    "csv_round_trip": csv_round_trip,
    "incremental": incremental_mails,
    "dedup_first": dedup_first,
}

_EXPORT = ", ".join(COMMIT_EXPORT)
_EMAIL_EXPORT = ", ".join(EMAIL_EXPORT)

ORACLES = {
    "commits": f"WITH {ARCHIVE_SQL} SELECT * FROM commits",
    "emails": f"WITH {ARCHIVE_SQL} SELECT * FROM emails",
    "reject_summary": f"""
        WITH {ARCHIVE_SQL}
        SELECT CASE WHEN NOT has_body THEN 'empty_body' WHEN NOT has_date THEN 'bad_date'
                    WHEN kind = 'none' THEN 'unclassified' WHEN kind = 'git empty' THEN 'no_changes' END AS reject_reason,
               count(*) AS n
        FROM firsts WHERE NOT has_body OR NOT has_date OR kind IN ('none', 'git empty') GROUP BY 1""",
    "mbox_scan": """
        SELECT source AS project, CASE WHEN doc_id % 2 = 0 THEN 'dev' ELSE 'commits' END AS folder,
               (doc_id % 12) || '.mbox' AS mbox, doc_id::VARCHAR AS message_id, 'd' || doc_id AS subject
        FROM documents""",
    "mbox_records": """
        SELECT source AS project,
               sum(1 + len(string_split(chr(10) || text, chr(10) || 'From ')) - 1)::BIGINT AS n_records,
               count(*) AS n_mails
        FROM documents GROUP BY 1""",
    "ascii_clean": f"""
        SELECT doc_id, rtrim(substr(string_split(chr(10) || clean, chr(10) || 'From ')[1], 2), chr(10)) AS body
        FROM (SELECT doc_id, {CLEAN_SQL} AS clean FROM documents)""",
    "commits_union": f"WITH {ARCHIVE_SQL} SELECT {_EXPORT} FROM commits",
    "emails_union": f"WITH {ARCHIVE_SQL} SELECT {_EMAIL_EXPORT} FROM emails",
    "archive_run": f"""
        WITH {ARCHIVE_SQL}
        SELECT proj_name, mbox, folder, message_id, period, status, message_date, author_name AS who,
               author_email AS address, file_op || ' ' || file_path AS what, addlines, dellines FROM commits
        UNION ALL
        SELECT proj_name, mbox, folder, message_id, period, status, message_date,
               CASE WHEN kind = 'svn reply' AND doc_id % 37 <> 0 THEN 'jdoe'
                    WHEN kind = 'git reply' AND doc_id % 37 <> 0 THEN 'G' || who
                    WHEN doc_id % 13 = 0 OR kind = 'svn reply' THEN local_name
                    WHEN kind = 'git reply' THEN local_name ELSE 'Dev ' || who END,
               CASE WHEN kind = 'git reply' AND doc_id % 37 <> 0 THEN 'g' || who ELSE local_name END || '@x.org',
               CASE WHEN kind = 'svn' THEN 'r' || doc_id || ' - trunk'
                    ELSE CASE WHEN kind LIKE '% reply' THEN 'Re: reply ' WHEN kind = 'mail' AND doc_id % 8 = 2 THEN 'Re: topic '
                              ELSE 'topic ' END || doc_id END, NULL, NULL
        FROM firsts
        -- An SVN notice without a text is a plain mail by its headers; its body in a file is a line break.
        WHERE has_date AND (kind IN ('mail', 'client', 'svn reply', 'git reply') OR (kind = 'svn' AND doc_id % 37 = 0))""",
    "run_counts": f"""
        WITH {ARCHIVE_SQL}
        SELECT CASE WHEN NOT has_body THEN 'empty_body' WHEN NOT has_date THEN 'bad_date'
                    WHEN kind = 'none' THEN 'unclassified' WHEN kind = 'git empty' THEN 'no_changes'
                    WHEN kind IN ('mail', 'client', 'svn reply', 'git reply') THEN 'emails' ELSE 'notices' END AS place,
               count(*) AS n FROM firsts GROUP BY 1
        UNION ALL SELECT 'messages', count(*) FROM firsts""",
    "nested_archive": """
        WITH files AS (
          SELECT doc_id, source AS proj_dir, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'commits' END AS folder,
                 (doc_id % 12) || '.mbox' AS mbox, doc_id % 4 = 1 AND doc_id % 12 < 6 AS nested, doc_id % 5 = 0 AS general
          FROM documents)
        SELECT doc_id, proj_dir, folder, mbox FROM files f
        WHERE (nested AND NOT general) OR (NOT nested AND NOT EXISTS (
          SELECT 1 FROM files n WHERE n.nested AND NOT n.general AND n.proj_dir = f.proj_dir
            AND n.folder = f.folder AND n.mbox = f.mbox))""",
    "csv_round_trip": r"""
        WITH marks AS (SELECT [chr(13), chr(10), chr(13) || chr(10), '"', ',', '\', '\"', 'a' || chr(13) || 'b',
                               chr(13) || chr(13), '",' || chr(13) || '"'] AS m)
        SELECT source || m[doc_id % 10 + 1] || text[1:40] || m[doc_id % 7 + 1] || 'z' AS subject, doc_id AS n,
               source AS proj_name, lang AS folder FROM documents, marks""",
    # The copy first by list, month and place stays, whichever drop brought it.
    "incremental": f"""
        WITH {ARCHIVE_SQL},
        arrived AS (
          SELECT *, row_number() OVER (PARTITION BY proj_dir, message_id
                                       ORDER BY folder, mbox, (doc_id // 7) % 3, doc_id) AS n,
                 doc_id % 37 <> 0 AS full_body FROM facts)
        SELECT proj_dir, folder, mbox, message_id,
               CASE WHEN kind IN ('svn subject', 'svn bare') THEN 'svn commit: r' || doc_id
                    WHEN kind LIKE '% reply' THEN 'Re: reply ' || doc_id WHEN kind = 'svn' THEN 'r' || doc_id || ' - trunk'
                    WHEN kind = 'git' THEN 'git commit: ' || doc_id
                    WHEN kind = 'mail' AND doc_id % 8 = 2 THEN 'Re: topic ' || doc_id ELSE 'topic ' || doc_id END AS subject,
               CASE WHEN doc_id % 41 <> 0 THEN strftime(day, '%a, %-d %b %Y') || ' 10:20:30 +0200' END AS message_date,
               CASE WHEN doc_id % 41 = 0 THEN 'bad_date' WHEN kind = 'none' THEN 'unclassified'
                    WHEN kind = 'git empty' OR (NOT full_body AND kind IN ('git', 'svn subject', 'svn bare')) THEN 'no_changes'
               END AS reject_reason,
               CASE WHEN full_body AND kind IN ('svn', 'svn subject', 'svn bare') THEN 3
                    WHEN full_body AND kind = 'git' THEN 1 ELSE 0 END AS n_changes
        FROM arrived WHERE n = 1""",
    "dedup_first": """
        SELECT doc_id, proj_dir, message_id, folder, mbox FROM (
          SELECT *, row_number() OVER (PARTITION BY proj_dir, message_id ORDER BY folder, mbox, doc_id) AS n
          FROM (SELECT doc_id, 'p' || ((doc_id // 50) % 20) AS proj_dir,
                  '<' || CASE WHEN doc_id % 10 = 9 THEN doc_id - 1 ELSE doc_id END || '@h>' AS message_id,
                  'l' || (doc_id % 3) AS folder, 'm' || (doc_id % 12) AS mbox FROM documents))
        WHERE n = 1""",
}
