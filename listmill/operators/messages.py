"""Raw mails to parsed messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from listmill.functions import classify, dates, diffs, mime, people, text

KEYS = ["proj_dir", "folder", "mbox", "file_path", "block_start", "seq"]


def with_headers(mails: DataFrame) -> DataFrame:
    """Split off the header block and pick its wanted fields."""
    return mails.withColumn("head", text.header_block(F.col("raw"))).withColumn(
        "lines", text.header_lines(F.col("head"))
    )


def with_message_id(mails: DataFrame) -> DataFrame:
    """Mails that have a Message-ID; a record without one is the tail of another mail.

    The id is exploded out of an array that holds it only when it is not empty. A filter
    would be pushed below the columns it reads and repeat the work on every header.
    """
    found = F.array(text.header_text(F.col("lines"), "message-id"))
    return mails.select("*", F.explode(F.filter(found, lambda i: i != "")).alias("message_id"))


def with_body(mails: DataFrame) -> DataFrame:
    """The decoded text as ``body``; every step is a column, so that none runs twice."""
    lines = F.col("lines")
    typed = mails.withColumns(
        {"media_type": mime.content_type(lines), "encoding": mime.transfer_encoding(lines)}
    )
    parts = mime.text_part(F.col("raw"), F.col("head"), F.col("media_type"), F.col("encoding"))
    return typed.withColumn("part", parts).withColumn(
        "body", mime.decode_payload(F.col("part.text"), F.col("part.encoding"))
    )


def with_fields(mails: DataFrame) -> DataFrame:
    """Header values that later steps read."""
    lines = F.col("lines")
    fields = mails.withColumns(
        {
            "sender": text.header(lines, "from"),
            "receiver_email": text.header(lines, "to"),
            "cc_list": text.header(lines, "cc"),
            "subject": text.header(lines, "subject"),
            "header_date": text.header(lines, "date"),
            "reference_id": text.header(lines, "in-reply-to"),
            "x_mailer": text.header(lines, "x-mailer"),
            "has_git_header": text.has_header_prefix(lines, "x-git-"),
        }
    )
    return fields.withColumns(
        {
            "sender_name": people.mailbox_name(F.col("sender")),
            "sender_address": people.mailbox_address(F.col("sender")),
            "message_date": dates.clean_date(F.col("header_date")),
        }
    )


def with_class(mails: DataFrame) -> DataFrame:
    """Class by headers alone, and by subject before headers; the changes are not known yet."""
    return mails.withColumn(
        "header_class",
        classify.class_from_headers(F.col("x_mailer"), F.col("has_git_header"), F.col("sender")),
    ).withColumn(
        "raw_class", F.coalesce(classify.class_from_subject(F.col("subject")), F.col("header_class"))
    )


def with_changes(mails: DataFrame, strict: bool = False) -> DataFrame:
    """File changes and the final class.

    ``strict`` leaves a mail with a foreign mailer in the SVN class although it holds no
    change, so that it is rejected.
    """
    parsed = mails.withColumn(
        "changes",
        F.when(F.col("raw_class") == "SVN", diffs.svn_changes(F.col("body")))
        .when(F.col("raw_class") == "Git", diffs.git_changes(F.col("body"))),
    )
    settled = classify.settle_class(
        F.col("raw_class"), F.col("subject"), F.coalesce(F.size("changes"), F.lit(0))
    )
    return parsed.withColumn("msg_format", F.col("raw_class") if strict else settled)


def with_people(mails: DataFrame) -> DataFrame:
    """Author and committer; the author of a plain mail is its sender.

    The class by headers decides where names come from, whatever the subject makes of the
    mail later. Without such a class there are no names.
    """
    name, address, raw = F.col("sender_name"), F.col("sender_address"), F.col("raw")
    kind = F.col("header_class")
    return mails.withColumn(
        "author",
        F.when(kind == "SVN", people.svn_author(name, address, raw))
        .when(kind == "Git", people.git_author(raw))
        .when(kind == "EMAIL", people.email_sender(name, address)),
    ).withColumn(
        "committer",
        F.when(kind == "Git", people.git_committer(F.col("author"), address, raw))
        .otherwise(F.col("author")),
    )


def with_reason(mails: DataFrame) -> DataFrame:
    """Why a mail goes to neither table; null where it goes to one.

    A notice without a file change has no row among the commits: ``no_changes``.
    """
    no_changes = F.col("msg_format").isin("SVN", "Git") & (F.coalesce(F.size("changes"), F.lit(0)) <= 0)
    reason = (
        F.when(F.coalesce(F.length("body"), F.lit(0)) == 0, "empty_body")
        .when(F.col("message_date").isNull(), "bad_date")
        .when(F.col("msg_format").isNull(), "unclassified")
        .when(no_changes, "no_changes")
    )
    return mails.withColumn("reject_reason", reason)


def parse_mails(mails: DataFrame, strict: bool = False, with_content: bool = False) -> DataFrame:
    """One narrow row per mail with a Message-ID; all texts but the optional content go.

    Everything here is row by row. It runs before the duplicates are removed, so that
    the exchange which does that carries parsed columns and no raw mail.
    """
    is_git = F.col("msg_format") == "Git"
    raw = F.col("raw")
    content = text.flatten_whitespace(F.col("body")) if with_content else F.lit(None).cast("string")
    return (
        mails.transform(with_headers)
        .transform(with_message_id)
        .transform(with_body)
        .transform(with_fields)
        .transform(with_class)
        .transform(with_changes, strict)
        .transform(with_people)
        .transform(with_reason)
        .select(
            *KEYS,
            F.replace("proj_dir", F.lit(".incubator"), F.lit("")).alias("proj_name"),
            "message_id",
            "reference_id",
            "message_date",
            dates.wall_clock(F.col("message_date")).alias("message_ts"),
            "receiver_email",
            "cc_list",
            "subject",
            content.alias("content"),
            "msg_format",
            "author",
            "committer",
            F.when(is_git, diffs.git_author_date(raw)).alias("author_date"),
            F.when(is_git, diffs.git_commit_date(raw)).alias("commit_date"),
            F.when(is_git, diffs.git_revision(raw)).alias("revision"),
            "reject_reason",
            "changes",
        )
    )


def first_copies(messages: DataFrame) -> DataFrame:
    """The first copy of each Message-ID in a project directory, across lists and months.

    Spark keeps one row per key and task before the exchange, so a Message-ID with very
    many copies costs its reducer one row per map task.
    """
    order = W.partitionBy("proj_dir", "message_id").orderBy(
        "folder", "mbox", "file_path", "block_start", "seq"
    )
    return messages.withColumn("copy_no", F.row_number().over(order)).filter("copy_no = 1").drop("copy_no")
