"""Raw mails made of the benchmark tables, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def doc_id() -> Column:
    return F.col("doc_id")



def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line(name: str, value: Column) -> Column:
    """A header line; null, and so left out, where the value is null."""
    return F.concat(F.lit(f"{name}: "), value)


def mail(*headers: Column, body: Column) -> Column:
    return F.concat_ws("\n", *headers, F.lit(""), body)


def words(*parts: Column | str) -> Column:
    """Concatenation; plain strings are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def as_mails(rows: DataFrame, raw: Column, seq: Column, *keep: str) -> DataFrame:
    """Rows with ``proj_dir``, ``folder`` and ``mbox`` to the ``MAIL`` schema."""
    mails = rows.select(
        "proj_dir",
        "folder",
        "mbox",
        F.concat_ws("/", "proj_dir", "folder", "mbox").alias("file_path"),
        F.lit(0).cast("bigint").alias("block_start"),
        seq.alias("seq"),
        raw.alias("raw"),
        *keep,
    )
    return mails


def signed(text: Column, *signs: str) -> Column:
    """Every line of a text behind one of the signs, in turn."""
    marks = F.array(*[F.lit(s) for s in signs])
    return F.array_join(
        F.transform(
            F.split(text, "\n"),
            lambda l, i: F.concat(F.get(marks, i % len(signs)), l),
        ),
        "\n",
    )


def svn_notice(path: Column, text: Column) -> Column:
    """One modified, one added and one copied file, with the text as their diffs."""
    ruler = "\n==============================\n"
    return words(
        "Author: jdoe\nNew Revision: 1\n\nModified: ", path, ruler, signed(text, "+", "-", " "),
        "\n\nAdded: ", path, ".new", ruler, signed(text, "+", " "),
        "\n\nCopied: ", path, ".copy (from r1, ", path, ")", ruler, signed(text, " ", " ", " ", "-"),
    )


def git_diff(path: Column, old: Column, new: Column, text: Column) -> Column:
    """One file with a diff and one without."""
    return words(
        "http://h/", path, "\n----------\ndiff --git a/f b/f\nindex 1..2 100644\n--- ", old,
        "\n+++ ", new, "\n@@ -1 +1 @@\n", signed(text, "+", "-", " "),
        "\n\nhttp://h/", path, ".bin\n----------\ndiff --git a/b b/b\nBinary files differ\n",
    )


def archive_of(documents: DataFrame) -> DataFrame:
    """An archive with every case of the parser, one mail per document.

    Project, list, month and all defects follow from ``doc_id``; see ``ARCHIVE_SQL``.
    """
    number = F.floor(doc_id() / 10) % 20
    second = F.floor(doc_id() / 200) % 2 == 1
    project = words("proj", number)
    kind = (
        F.when(doc_id() % 43 == 0, "none")
        .when(doc_id() % 47 == 0, "client")
        .when(doc_id() % 53 == 0, "svn reply")
        .when(doc_id() % 59 == 0, "git reply")
        .when(doc_id() % 61 == 0, "svn bare")
        .when(doc_id() % 67 == 0, "git empty")
        .when(doc_id() % 4 == 0, "svn")
        .when(doc_id() % 4 == 1, "git")
        .when(doc_id() % 4 == 2, "mail")
        .otherwise("svn subject")
    )
    key = F.when(doc_id() % 10 == 9, doc_id() - 1).when((doc_id() % 10 == 5) & second, doc_id() - 200).otherwise(doc_id())
    day = F.date_add(F.lit("2018-01-01").cast("date"), (doc_id() % 1500).cast("int"))
    rows = documents.select(
        "doc_id",
        "text",
        "source",
        F.when(doc_id() % 50 == 7, "asf-wide")
        .when(doc_id() % 50 == 17, "incubator")
        .when(doc_id() % 50 == 27, "attic")
        .when(second, words(project, ".incubator"))
        .otherwise(project)
        .alias("proj_dir"),
        F.when(doc_id() % 3 == 0, "commits").when(doc_id() % 3 == 1, "dev").otherwise("svn").alias("folder"),
        words("2019", F.lpad((doc_id() % 12 + 1).cast("string"), 2, "0"), ".mbox").alias("mbox"),
        F.when(doc_id() % 31 != 0, words("<", key, "@h>")).alias("message_id"),
        kind.alias("kind"),
        words(F.date_format(day, "EEE, d MMM yyyy"), " 10:20:30 ").alias("moment"),
        (doc_id() % 97).alias("who"),
    )
    kind, who, path = F.col("kind"), F.col("who"), words(F.col("source"), "/f", doc_id())
    address = words("dev", who, "@x.org")
    subject = (
        F.when(kind.isin("svn subject", "svn bare"), words("svn commit: r", doc_id()))
        .when(kind.isin("svn reply", "git reply"), words("Re: reply ", doc_id()))
        .when(kind == "svn", words("r", doc_id(), " - trunk"))
        .when(kind == "git", words("git commit: ", doc_id()))
        .when((kind == "mail") & (doc_id() % 8 == 2), words("Re: topic ", doc_id()))
        .otherwise(words("topic ", doc_id()))
    )
    old = F.when(doc_id() % 8 == 1, "/dev/null").otherwise("a/f")
    git = F.concat_ws(
        "\n",
        F.lit("Project: p"),
        F.when(doc_id() % 8 == 1, words("Author: G", who, " <g", who, "@x.org>")),
        F.when(doc_id() % 3 == 0, words("Authored: ", doc_id())),
        F.when(doc_id() % 3 == 1, words("AuthorDate: ", doc_id())),
        F.when(doc_id() % 5 != 0, words("Committed: ", doc_id())),
        words("Committer: H", who, " <h", who, "@x.org>"),
        F.lit(""),
        git_diff(path, old, F.lit("b/f"), F.col("text")),
    )
    body = (
        F.when(doc_id() % 37 == 0, "")
        .when(kind.isin("svn", "svn subject", "svn bare", "svn reply"), svn_notice(path, F.col("text")))
        .when(kind == "git reply", words("Author: G", who, " <g", who, "@x.org>\n", F.col("text")))
        .when(kind == "git", git)
        .otherwise(F.col("text"))
    )
    raw = mail(
        line("Message-Id", F.col("message_id")),
        line("From", F.when(~kind.isin("none", "svn bare"), F.when((doc_id() % 13 == 0) | (kind == "svn reply"), address).otherwise(words("Dev ", who, " <", address, ">")))),
        line("To", F.lit("dev@x.org")),
        line("CC", F.when(doc_id() % 6 == 2, "all@x.org")),
        line("Subject", subject),
        line("Date", words(F.col("moment"), F.when(doc_id() % 41 == 0, "GMT").otherwise("+0200 (CEST)"))),
        line("In-Reply-To", F.when(doc_id() % 4 == 2, words("<", doc_id() - 4, "@h>"))),
        line("X-Mailer", F.when(kind.isin("svn", "svn reply"), "svnmailer-1.0").when(kind == "client", "Outlook")),
        line("X-Git-Rev", F.when(kind.isin("git", "git reply", "git empty"), words("abc", doc_id()))),
        line("Content-Type", F.lit("text/plain; charset=utf-8")),
        body=body,
    )
    return as_mails(rows, raw, doc_id())


def project_dimension(nation: DataFrame) -> DataFrame:
    """Known projects; keys from 15 on are unknown, region 0 has no end date."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    end = F.date_add(F.lit("2019-06-01").cast("date"), key * 10)
    return nation.filter(key < 15).select(
        words("proj", key).alias("alias"),
        F.when(region % 3 == 0, "incubating")
        .when(region % 3 == 1, "graduated")
        .otherwise("retired")
        .alias("status"),
        F.when(region != 0, end).alias("end_date"),
    )


CLEAN_SQL = r"regexp_replace(text, '[^\x00-\x7F]', '', 'g')"

# The same archive as plain facts: what each document has to become.
ARCHIVE_SQL = rf"""
lines AS (
  SELECT *, string_split({CLEAN_SQL}, chr(10)) AS ls FROM documents
),
facts AS (
  SELECT doc_id, source, text, ls,
    len(list_filter(ls, lambda l, i: (i - 1) % 3 = 0 AND NOT starts_with(l, '+')))::INT AS plus3,
    len(list_filter(ls, lambda l, i: (i - 1) % 3 = 1 AND NOT starts_with(l, '-')))::INT AS minus3,
    len(list_filter(ls, lambda l, i: (i - 1) % 2 = 0 AND NOT starts_with(l, '+')))::INT AS plus2,
    len(list_filter(ls, lambda l, i: (i - 1) % 4 = 3 AND NOT starts_with(l, '-')))::INT AS minus4,
    'proj' || ((doc_id // 10) % 20) AS proj_name,
    'proj' || ((doc_id // 10) % 20) ||
      CASE WHEN (doc_id // 200) % 2 = 1 THEN '.incubator' ELSE '' END AS proj_dir,
    CASE doc_id % 3 WHEN 0 THEN 'commits' WHEN 1 THEN 'dev' ELSE 'svn' END AS folder,
    '2019' || lpad((doc_id % 12 + 1)::VARCHAR, 2, '0') || '.mbox' AS mbox,
    '<' || CASE WHEN doc_id % 10 = 9 THEN doc_id - 1
                WHEN doc_id % 10 = 5 AND (doc_id // 200) % 2 = 1 THEN doc_id - 200
                ELSE doc_id END || '@h>' AS message_id,
    CASE WHEN doc_id % 43 = 0 THEN 'none' WHEN doc_id % 47 = 0 THEN 'client'
         WHEN doc_id % 53 = 0 THEN 'svn reply' WHEN doc_id % 59 = 0 THEN 'git reply'
         WHEN doc_id % 61 = 0 THEN 'svn bare' WHEN doc_id % 67 = 0 THEN 'git empty'
         WHEN doc_id % 4 = 0 THEN 'svn' WHEN doc_id % 4 = 1 THEN 'git'
         WHEN doc_id % 4 = 2 THEN 'mail' ELSE 'svn subject' END AS kind,
    DATE '2018-01-01' + (doc_id % 1500)::INT AS day,
    doc_id % 97 AS who,
    'dev' || (doc_id % 97) AS local_name,
    length(array_to_string(ls, chr(10))) AS n_clean
  FROM lines
  WHERE doc_id % 31 <> 0 AND doc_id % 50 NOT IN (7, 17, 27)
),
copies AS (
  SELECT *, row_number() OVER (PARTITION BY proj_dir, message_id ORDER BY folder, mbox, doc_id) AS copy_no
  FROM facts
),
dim AS (
  SELECT 'proj' || n_nationkey AS alias,
    CASE n_regionkey % 3 WHEN 0 THEN 'incubating' WHEN 1 THEN 'graduated' ELSE 'retired' END AS known_status,
    CASE WHEN n_regionkey <> 0 THEN DATE '2019-06-01' + (n_nationkey * 10)::INT END AS end_date
  FROM nation WHERE n_nationkey < 15
),
firsts AS (
  SELECT c.*, coalesce(known_status, 'incubating') AS status,
    trunc((day - end_date) / 30.0)::INT AS period,
    strftime(day, '%a, %-d %b %Y') || ' 10:20:30 +0200' AS message_date,
    doc_id % 37 <> 0 AND (kind NOT IN ('mail', 'client', 'none', 'git empty') OR n_clean > 0) AS has_body,
    doc_id % 41 <> 0 AS has_date
  FROM copies c LEFT JOIN dim ON alias = proj_name
  WHERE copy_no = 1
),
commits AS (
  SELECT f.proj_name, f.mbox, f.folder, f.message_id, f.period, f.status, f.message_date,
    CASE WHEN kind = 'git' THEN CASE WHEN doc_id % 3 = 2 THEN '' ELSE doc_id::VARCHAR END END AS author_date,
    CASE WHEN kind = 'git' THEN CASE WHEN doc_id % 5 = 0 THEN '' ELSE doc_id::VARCHAR END END AS commit_date,
    -- names follow the headers: only a mailer makes the Author line of an SVN notice count
    CASE WHEN kind = 'svn bare' THEN NULL
         WHEN kind <> 'git' THEN CASE WHEN doc_id % 13 <> 0 THEN 'Dev ' || who WHEN kind = 'svn' THEN 'jdoe' ELSE local_name END
         WHEN doc_id % 8 = 1 THEN 'G' || who END AS author_name,
    CASE WHEN kind = 'svn bare' THEN NULL WHEN kind <> 'git' THEN local_name || '@x.org'
         WHEN doc_id % 8 = 1 THEN 'g' || who || '@x.org' END AS author_email,
    CASE WHEN kind = 'svn bare' THEN NULL
         WHEN kind <> 'git' THEN CASE WHEN doc_id % 13 <> 0 THEN 'Dev ' || who WHEN kind = 'svn' THEN 'jdoe' ELSE local_name END
         WHEN doc_id % 8 = 1 THEN 'H' || who ELSE local_name END AS committer_name,
    CASE WHEN kind = 'svn bare' THEN NULL WHEN kind <> 'git' THEN local_name || '@x.org'
         WHEN doc_id % 8 = 1 THEN 'h' || who || '@x.org' ELSE local_name || '@x.org' END AS committer_email,
    CASE WHEN kind = 'git' THEN 'Git' ELSE 'SVN' END AS msg_format,
    CASE WHEN kind = 'git' THEN 'h/' ELSE '' END || source || '/f' || doc_id || suffix AS file_path,
    CASE WHEN kind = 'git' THEN CASE WHEN doc_id % 8 = 1 THEN 'add' ELSE 'mod' END ELSE op END AS file_op,
    CASE WHEN suffix = '' THEN plus3 WHEN suffix = '.new' THEN plus2 ELSE 0 END AS addlines,
    CASE WHEN suffix = '' THEN minus3 WHEN suffix = '.new' THEN 0 ELSE minus4 END AS dellines,
    'ASF' AS source
  FROM firsts f, (VALUES ('', 'mod'), ('.new', 'add'), ('.copy', 'copy')) t(suffix, op)
  WHERE has_body AND has_date
    AND (kind IN ('svn', 'svn subject', 'svn bare') OR (kind = 'git' AND suffix = ''))
),
emails AS (
  SELECT proj_name, mbox, folder, message_id, period, status,
    CASE WHEN doc_id % 4 = 2 THEN '<' || (doc_id - 4) || '@h>' END AS reference_id,
    message_date, CASE WHEN kind = 'git reply' THEN 'g' || who ELSE local_name END || '@x.org' AS sender_email,
    CASE WHEN kind = 'svn reply' THEN 'jdoe' WHEN kind = 'git reply' THEN 'G' || who
         WHEN doc_id % 13 = 0 THEN local_name ELSE 'Dev ' || who END AS sender_name,
    'dev@x.org' AS receiver_email,
    CASE WHEN doc_id % 6 = 2 THEN 'all@x.org' END AS cc_list,
    CASE WHEN kind LIKE '% reply' THEN 'Re: reply ' WHEN kind = 'mail' AND doc_id % 8 = 2 THEN 'Re: topic '
         ELSE 'topic ' END || doc_id AS subject,
    NULL::VARCHAR AS content, 'ASF' AS source
  FROM firsts WHERE has_body AND has_date AND kind IN ('mail', 'client', 'svn reply', 'git reply')
)
"""
