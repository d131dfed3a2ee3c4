"""Queries over single parser steps: diffs, MIME, headers, people, dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.functions import classify, dates, diffs, people, text
from listmill.operators import messages
from listmill.operators.projects import with_project
from listmill.scratch import shared_folder
from listmill.sources.projects import read_projects
from listmill.workloads.mails import CLEAN_SQL, doc_id, git_diff, line, mail, svn_notice, table, words

CHANGE_COLUMNS = ["change_no", "file_path", "file_op", "addlines", "dellines"]


def _changes(rows: DataFrame, key: str, changes) -> DataFrame:
    exploded = rows.select(key, F.posexplode(changes).alias("change_no", "change"))
    return exploded.select(key, "change_no", "change.*")


def svn_changes(spark: SparkSession, sf: str) -> DataFrame:
    path = words(F.col("source"), "/f", doc_id())
    bodies = table(spark, sf, "documents").select(
        "doc_id", svn_notice(path, text.strip_non_ascii(F.col("text"))).alias("body")
    )
    return _changes(bodies, "doc_id", diffs.svn_changes(F.col("body")))


def svn_lists(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    body = words(
        "Author: a\n\nRemoved:\n    old/", F.col("p_name"), "\n    old/", key,
        "\nAdded:\n    ", F.col("p_brand"), "/\n      - copied from r1, b/\n    new/", key,
        "\nModified:\n    not/listed\n\nlast line\n",
    )
    bodies = table(spark, sf, "part").select("p_partkey", body.alias("body"))
    return _changes(bodies, "p_partkey", diffs.svn_changes(F.col("body")))


def git_changes(spark: SparkSession, sf: str) -> DataFrame:
    kind = doc_id() % 4
    old = F.when(kind == 1, "/dev/null").otherwise("a/f")
    new = F.when(kind == 2, "/dev/null").when(kind == 3, "b/g").otherwise("b/f")
    path = words(F.col("source"), "/f", doc_id())
    bodies = table(spark, sf, "documents").select(
        "doc_id",
        words("Commit: x\n\n", git_diff(path, old, new, text.strip_non_ascii(F.col("text")))).alias("body"),
    )
    return _changes(bodies, "doc_id", diffs.git_changes(F.col("body")))


def _quoted_printable(data):
    """Every byte as ``=XX``, with a soft line break after each 20."""
    return F.regexp_replace(F.regexp_replace(F.hex(data), "(..)", "=$1"), "((?:=..){20})", "$1=\n")


def mime_body(spark: SparkSession, sf: str) -> DataFrame:
    """One mail per turn: parts within parts, three encodings and two charsets."""
    way = (F.col("conv_id") * 7 + F.col("turn")) % 4
    said = F.col("text")
    encoding = F.when(way == 0, "8bit").when(way == 2, "quoted-printable").otherwise("base64")
    payload = (
        F.when(way == 0, said)
        .when(way == 1, F.base64(said.cast("binary")))
        .when(way == 2, _quoted_printable(said.cast("binary")))
        .otherwise(F.base64(F.encode(said, "ISO-8859-1")))
    )
    outer, inner = words("out-", F.col("conv_id")), words("in=", F.col("turn"))
    parts = words(
        "preamble\n--", outer, "\nContent-Type: text/plain\n\ncover\n--", outer,
        "\nContent-Type: multipart/alternative;\n boundary=\"", inner, "\"\n\n--", inner,
        "\nContent-Type: text/plain; charset=x\nContent-Transfer-Encoding: ", encoding, "\n\n", payload,
        "\n--", inner, "\nContent-Type: text/html\n\n<p>no</p>\n--", inner, "--\n\n--", outer,
        "\nContent-Type: application/x\n\nno\n--", outer, "--\nepilogue\n",
    )
    single = F.col("turn") % 5 == 4
    raw = mail(
        F.lit("Message-ID: <x@h>"),
        F.when(single, "Content-Type: text/plain").otherwise(
            words("Content-Type: multipart/mixed; boundary=", outer)
        ),
        F.when(single, line("Content-Transfer-Encoding", encoding)),
        body=F.when(single, payload).otherwise(parts),
    )
    mails = table(spark, sf, "conversations").select(
        "conv_id", "turn", text.strip_non_ascii(raw).alias("raw")
    )
    return (
        mails.transform(messages.with_headers).transform(messages.with_body).select("conv_id", "turn", "body")
    )


def reply_edges(spark: SparkSession, sf: str) -> DataFrame:
    name, turn = words("<", F.col("conv_id"), ".", F.col("turn"), "@h>"), F.col("turn")
    parent = words("<", F.col("conv_id"), ".", turn - 1, "@h>")
    raw = mail(
        line("Message-ID", name),
        F.when(turn > 0, words("In-Reply-To:\n ", parent)),
        line("From", words(F.col("role"), "@h")),
        body=F.col("text"),
    )
    mails = table(spark, sf, "conversations").select(raw.alias("raw"))
    found = mails.transform(messages.with_headers).transform(messages.with_message_id)
    return found.select("message_id", text.header(F.col("lines"), "in-reply-to").alias("reference_id"))


def classify_mails(spark: SparkSession, sf: str) -> DataFrame:
    kind, topic = doc_id() % 6, doc_id() % 5
    raw = mail(
        line("Message-ID", words(doc_id())),
        line("X-MAILER", F.when(kind == 0, "svnmailer-1").when(kind == 1, "ASF-Git Admin Mailer").when(kind == 4, "Outlook")),
        line("X-Git-Rev", F.when(kind == 1, "abc")),
        line("x-git-repo", F.when(kind == 5, "r")),
        line("From", F.when(kind != 3, "a@h")),
        line("Subject", F.when(topic == 0, "Re: x").when(topic == 1, "svn commit: r1").when(topic == 2, "Re:").when(topic == 4, "news")),
        body=F.col("text"),
    )
    lines = F.col("lines")
    fields = (
        table(spark, sf, "documents")
        .select("doc_id", raw.alias("raw"))
        .transform(messages.with_headers)
        .select(
            "doc_id",
            text.header(lines, "subject").alias("subject"),
            text.header(lines, "x-mailer").alias("x_mailer"),
            text.has_header_prefix(lines, "x-git-").alias("has_git"),
            text.header(lines, "from").alias("sender"),
        )
    )
    by_header = classify.class_from_headers(F.col("x_mailer"), F.col("has_git"), F.col("sender"))
    by_subject = classify.class_from_subject(F.col("subject"))
    return fields.select(
        "doc_id",
        by_header.alias("header_class"),
        by_subject.alias("subject_class"),
        F.coalesce(by_subject, by_header).alias("msg_class"),
    )


def people_of(spark: SparkSession, sf: str) -> DataFrame:
    key, form = F.col("c_custkey"), F.col("c_custkey") % 5
    address = words("c", key, "@h.org")
    sender = (
        F.when(form == 0, words(F.col("c_name"), " <", address, ">"))
        .when(form == 1, words('"', F.col("c_mktsegment"), ", ", F.col("c_name"), '" <', address, ">"))
        .when(form == 2, address)
        .when(form == 3, words(address, " (", F.col("c_name"), ")"))
        .otherwise(words("<", address, ">"))
    )
    note = F.when(key % 2 == 0, words("Hello\n\nAuthor: a", key, "\n")).otherwise("Hello\n")
    named = table(spark, sf, "customer").select(
        "c_custkey",
        people.mailbox_name(sender).alias("display_name"),
        people.mailbox_address(sender).alias("address"),
        note.alias("note"),
    )
    name, where = F.col("display_name"), F.col("address")
    return named.select(
        "c_custkey",
        "display_name",
        "address",
        people.email_sender(name, where)["name"].alias("sender_name"),
        people.svn_author(name, where, F.col("note"))["name"].alias("svn_name"),
    )


def git_meta(spark: SparkSession, sf: str) -> DataFrame:
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.concat_ws(
        "\n",
        F.lit("Subject: s"),
        F.when(key % 6 != 0, words("X-Git-Rev: x", key)),
        F.lit(""),
        words("Commit: c", key),
        F.when(key % 7 != 0, words("Author: A", who, " B <a", who, "@h>")),
        F.when(key % 3 == 0, words("Authored: ", day)),
        F.when(key % 3 == 1, words("AuthorDate: ", day)),
        F.when(key % 4 != 0, words("Committed: ", day)),
        F.when(key % 5 != 0, words("Committer: C", who, " <c", who, "@h>")),
        F.lit("end"),
    )
    mails = table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))
    authored = mails.withColumn("author", people.git_author(F.col("raw")))
    committer = people.git_committer(F.col("author"), F.lit("robot@h"), F.col("raw"))
    return authored.withColumn("committer", committer).select(
        "o_orderkey",
        F.col("author.name").alias("author_name"),
        F.col("author.email").alias("author_email"),
        F.col("committer.name").alias("committer_name"),
        F.col("committer.email").alias("committer_email"),
        diffs.git_author_date(F.col("raw")).alias("author_date"),
        diffs.git_commit_date(F.col("raw")).alias("commit_date"),
        diffs.git_revision(F.col("raw")).alias("revision"),
    )


def mail_text(spark: SparkSession, sf: str) -> DataFrame:
    raw = mail(
        line("Message-ID", words(doc_id())),
        line("Subject", F.when(doc_id() % 9 != 0, words("about\n ", F.col("source")))),
        body=text.strip_non_ascii(F.col("text")),
    )
    mails = table(spark, sf, "documents").select("doc_id", raw.alias("raw")).transform(messages.with_headers)
    body = text.after_header(F.col("raw"), F.col("head"))
    return mails.select(
        "doc_id",
        text.header(F.col("lines"), "subject").alias("subject"),
        text.flatten_whitespace(body).alias("content"),
    )


def _event_date():
    form, ts = F.col("event_id") % 11, F.col("ts")
    day, clock = F.date_format(ts, "d MMM"), F.date_format(ts, "HH:mm:ss")
    year = F.date_format(ts, "yyyy")
    full = words(F.date_format(ts, "EEE"), ", ", day, " ", year, " ", clock)
    return (
        F.when(form == 0, words(full, " GMT"))
        .when(form == 1, words(day, " ", year, " ", clock))
        .when(form == 3, words(F.date_format(ts, "EEE"), ", ", day, " ", F.substring(year, 3, 2), " ", clock, " -0800"))
        .when(form == 4, words(full, " -0700 (PDT)"))
        .when(form == 5, words(day, " ", year, " ", clock, " +0000"))
        .when(form != 2, words(full, " +0530"))
    )


def mail_dates(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "events").select("event_id", dates.clean_date(_event_date()).alias("message_date"))
    return given.withColumn("message_ts", dates.wall_clock(F.col("message_date")))


def rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons over mails whose dates and bodies come from the events."""
    key = F.col("event_id")
    kept = table(spark, sf, "events").select(
        F.when(key % 13 != 0, F.col("props")).alias("body"),
        dates.clean_date(_event_date()).alias("message_date"),
        F.when(key % 17 != 0, F.when(key % 19 == 0, "SVN").otherwise("EMAIL")).alias("msg_format"),
        F.when(key % 2 == 0, F.array(key)).alias("changes"),
    )
    marked = kept.transform(messages.with_reason).filter(F.col("reject_reason").isNotNull())
    return marked.groupBy("reject_reason").agg(F.count("*").alias("n"))


def period_of(spark: SparkSession, sf: str) -> DataFrame:
    end = F.lit("1998-01-01").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.period(F.col("o_orderdate"), end).alias("period")
    )


def project_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The dimension takes the way through CSV, with a repeated alias and both date forms."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    nation = table(spark, sf, "nation").filter(key < 15)
    ends = F.date_add(F.lit("2019-06-01").cast("date"), key * 10)
    rows = nation.select(
        words(key).alias("listid"),
        F.col("n_name").alias("listname"),
        words("proj", key).alias("pj_alias"),
        F.when(region % 3 == 0, "incubating").when(region % 3 == 1, "graduated").otherwise("retired").alias("status"),
        F.lit("2001-01-01").alias("start_date"),
        F.when(region == 0, "NULL")
        .when(key % 2 == 0, F.date_format(ends, "M/d/yyyy"))
        .otherwise(F.date_format(ends, "yyyy-MM-dd"))
        .alias("end_date"),
    )
    stale = rows.filter("listid = '3'").withColumn("status", F.lit("stale"))
    path = shared_folder(spark, "projects")
    stale.unionByName(rows).coalesce(1).write.option("header", True).csv(path)
    facts = table(spark, sf, "documents").select(
        "doc_id",
        F.replace(words("proj", doc_id() % 20, ".incubator"), F.lit(".incubator"), F.lit("")).alias("proj_name"),
        F.date_add(F.lit("2018-01-01").cast("date"), (doc_id() % 1500).cast("int")).cast("timestamp_ntz").alias("message_ts"),
    )
    joined = facts.transform(with_project, read_projects(spark, path))
    return joined.select("doc_id", "proj_name", "status", "period")


QUERIES = {
    "svn_changes": svn_changes,
    "svn_lists": svn_lists,
    "git_changes": git_changes,
    "mime_body": mime_body,
    "reply_edges": reply_edges,
    "classify": classify_mails,
    "people": people_of,
    "git_meta": git_meta,
    "mail_text": mail_text,
    "mail_dates": mail_dates,
    "rejects": rejects,
    "period": period_of,
    "project_lookup": project_lookup,
}

_LINES = rf"(SELECT doc_id, source, string_split({CLEAN_SQL}, chr(10)) AS ls FROM documents)"


def _count(period: int, places: str, sign: str) -> str:
    return (
        f"len(list_filter(ls, lambda l, i: (i - 1) % {period} IN ({places}) "
        f"AND NOT starts_with(l, '{sign}')))::INT"
    )


_EVENT_FORMS = """
  SELECT *, event_id % 11 AS form,
    strftime(ts, '%a, ') AS wd, strftime(ts, '%-d %b %Y %H:%M:%S') AS long_date,
    strftime(ts, '%-d %b 20%y %H:%M:%S') AS short_date
  FROM events
"""

ORACLES = {
    "svn_changes": f"""
        SELECT doc_id, 0 AS change_no, source || '/f' || doc_id AS file_path, 'mod' AS file_op,
               {_count(3, "0", "+")} AS addlines, {_count(3, "1", "-")} AS dellines FROM {_LINES}
        UNION ALL
        SELECT doc_id, 1, source || '/f' || doc_id || '.new', 'add', {_count(2, "0", "+")}, 0 FROM {_LINES}
        UNION ALL
        SELECT doc_id, 2, source || '/f' || doc_id || '.copy', 'copy', 0, {_count(4, "3", "-")} FROM {_LINES}""",
    "svn_lists": """
        SELECT p_partkey, 0 AS change_no, 'old/' || p_name AS file_path, 'remove' AS file_op,
               0 AS addlines, 0 AS dellines FROM part
        UNION ALL SELECT p_partkey, 1, 'old/' || p_partkey, 'remove', 0, 0 FROM part
        UNION ALL SELECT p_partkey, 2, p_brand || '/', 'copy', 0, 0 FROM part
        UNION ALL SELECT p_partkey, 3, 'new/' || p_partkey, 'copy', 0, 0 FROM part""",
    "git_changes": f"""
        SELECT doc_id, 0 AS change_no, 'h/' || source || '/f' || doc_id AS file_path,
               CASE doc_id % 4 WHEN 0 THEN 'mod' WHEN 1 THEN 'add' WHEN 2 THEN 'del' ELSE 'copy' END AS file_op,
               {_count(3, "0", "+")} AS addlines, {_count(3, "1", "-")} AS dellines FROM {_LINES}""",
    "mime_body": f"""
        SELECT conv_id, turn, CASE WHEN (conv_id * 7 + turn) % 4 = 0 THEN {CLEAN_SQL} ELSE text END AS body
        FROM conversations""",
    "reply_edges": """
        SELECT '<' || c.conv_id || '.' || c.turn || '@h>' AS message_id,
               '<' || p.conv_id || '.' || p.turn || '@h>' AS reference_id
        FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1""",
    "classify": """
        SELECT doc_id, header_class, subject_class, coalesce(subject_class, header_class) AS msg_class
        FROM (SELECT doc_id,
          CASE WHEN doc_id % 6 IN (0, 4) THEN 'SVN' WHEN doc_id % 6 IN (1, 5) THEN 'Git'
               WHEN doc_id % 6 = 2 THEN 'EMAIL' END AS header_class,
          CASE doc_id % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'SVN' END AS subject_class FROM documents)""",
    "people": """
        SELECT c_custkey, display_name, 'c' || c_custkey || '@h.org' AS address,
               CASE WHEN display_name = '' THEN 'c' || c_custkey ELSE display_name END AS sender_name,
               CASE WHEN display_name <> '' THEN display_name
                    ELSE CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'c' END || c_custkey END AS svn_name
        FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment || ', ' || c_name
                WHEN 3 THEN c_name ELSE '' END AS display_name FROM customer)""",
    "git_meta": """
        SELECT o_orderkey,
          CASE WHEN o_orderkey % 7 <> 0 THEN 'A' || o_custkey || ' B' END AS author_name,
          CASE WHEN o_orderkey % 7 <> 0 THEN 'a' || o_custkey || '@h' END AS author_email,
          CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN 'C' || o_custkey ELSE 'robot' END AS committer_name,
          CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 THEN 'c' || o_custkey || '@h' ELSE 'robot@h' END AS committer_email,
          CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS author_date,
          CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS commit_date,
          CASE WHEN o_orderkey % 6 = 0 THEN 'c' ELSE 'x' END || o_orderkey AS revision
        FROM orders""",
    "mail_text": f"""
        SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN 'about ' || source END AS subject,
               translate({CLEAN_SQL}, chr(10) || chr(9), ';;') AS content
        FROM documents""",
    "mail_dates": f"""
        SELECT event_id,
          CASE WHEN form IN (0, 1, 2) THEN NULL WHEN form = 3 THEN short_date || ' -0800'
               WHEN form = 4 THEN wd || long_date || ' -0700' WHEN form = 5 THEN long_date || ' +0000'
               ELSE wd || long_date || ' +0530' END AS message_date,
          CASE WHEN form NOT IN (0, 1, 2) THEN date_trunc('second', ts) END AS message_ts
        FROM ({_EVENT_FORMS})""",
    "rejects": """
        SELECT reject_reason, count(*) AS n FROM (
          SELECT CASE WHEN event_id % 13 = 0 THEN 'empty_body' WHEN event_id % 11 IN (0, 1, 2) THEN 'bad_date'
                      WHEN event_id % 17 = 0 THEN 'unclassified'
                      WHEN event_id % 19 = 0 AND event_id % 2 = 1 THEN 'no_changes' END AS reject_reason FROM events)
        WHERE reject_reason IS NOT NULL GROUP BY 1""",
    "period": """
        SELECT o_orderkey, trunc((o_orderdate::DATE - DATE '1998-01-01') / 30.0)::INT AS period FROM orders""",
    "project_lookup": """
        SELECT doc_id, proj_name, coalesce(status, 'incubating') AS status,
               trunc((day - end_date) / 30.0)::INT AS period
        FROM (SELECT doc_id, 'proj' || (doc_id % 20) AS proj_name, DATE '2018-01-01' + (doc_id % 1500)::INT AS day
              FROM documents)
        LEFT JOIN (SELECT 'proj' || n_nationkey AS alias,
                     CASE n_regionkey % 3 WHEN 0 THEN 'incubating' WHEN 1 THEN 'graduated' ELSE 'retired' END AS status,
                     CASE WHEN n_regionkey <> 0 THEN DATE '2019-06-01' + (n_nationkey * 10)::INT END AS end_date
                   FROM nation WHERE n_nationkey < 15) ON alias = proj_name""",
}
