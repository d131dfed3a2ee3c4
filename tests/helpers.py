"""Short ways to run a column function on literal rows."""

from __future__ import annotations


from pyspark.sql import functions as F


def apply(spark, function, values, kind="string"):
    """Results of ``function(column)`` for each value, in order."""
    frame = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    rows = frame.select("i", function(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def mails(spark, *raws, proj_dir="proj", folder="dev", mbox="1.mbox"):
    rows = [(proj_dir, folder, mbox, "f", 0, i, raw) for i, raw in enumerate(raws)]
    schema = "proj_dir string, folder string, mbox string, file_path string, block_start bigint, seq bigint, raw string"
    return spark.createDataFrame(rows, schema)


def mail(body="text\n", **headers):
    """A raw mail; header names with underscores for hyphens, None leaves one out."""
    given = {
        "Message_ID": "<1@h>", "From": "Jo Doe <jo@h.org>", "Subject": "topic",
        "Date": "Mon, 3 Feb 2003 10:00:00 -0700",
    } | headers
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in given.items() if v is not None]
    return "\n".join(lines) + "\n\n" + body


def no_projects(spark):
    return spark.createDataFrame([], "alias string, status string, end_date date")



SVN_BODY = """Author: jdoe
New Revision: 1

Removed:
    trunk/old.txt
Added:
    trunk/dir/
      - copied from r1, branches/dir/
Modified: trunk/a.py
==============================
--- trunk/a.py (original)
+++ trunk/a.py Mon
+added
-removed
 same

Added: trunk/b.py
==============================
--- trunk/b.py (added)
+++ trunk/b.py Mon
+one
+two

Copied: trunk/c.py (from r1, trunk/b.py)
==============================
--- trunk/b.py (original)
+++ trunk/c.py Mon
-one
"""

GIT_BODY = """Commit: 0123abcd
Author: Jane Doe <jane@x.example>
AuthorDate: Mon Feb 3 10:00:00 2020 +0000
Committed: Mon Feb 3 11:00:00 2020 +0000
Committer: John Roe <john@x.example>

http://host.example/repo/f.py
diff --git a/f.py b/f.py
--- a/f.py
+++ b/f.py
+x
-y
-z

http://host.example/repo/g.py
diff --git a/g.py b/g.py
--- /dev/null
+++ b/g.py
+x
"""
