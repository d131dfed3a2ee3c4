"""Column lists and types of the tables."""

from __future__ import annotations

# One mail of an archive, as every reader and generator supplies it.
MAIL = (
    "proj_dir string, folder string, mbox string, "
    "file_path string, block_start bigint, seq bigint, raw string"
)

MESSAGES = (
    "proj_name string, mbox string, folder string, message_id string, period int, "
    "status string, reference_id string, message_date string, sender_email string, "
    "sender_name string, receiver_email string, cc_list string, subject string, "
    "content string, source string"
)

COMMITS = (
    "proj_name string, mbox string, folder string, message_id string, period int, "
    "status string, message_date string, author_date string, commit_date string, "
    "author_name string, author_email string, committer_name string, "
    "committer_email string, msg_format string, file_path string, file_op string, "
    "addlines int, dellines int, source string"
)

PROJECTS = (
    "id string, name string, status int, sponsor string, start_date date, "
    "end_date date, has_dev int, has_commit int, in_attic boolean, intro string, "
    "url string"
)

PROJECT_CSV = (
    "listid string, listname string, pj_alias string, status string, "
    "start_date string, end_date string"
)

# Columns of the two deliverables.
COMMIT_EXPORT = [
    "proj_name", "period", "status", "message_date", "author_name",
    "committer_name", "file_path", "addlines", "dellines",
]
EMAIL_EXPORT = [
    "proj_name", "mbox", "folder", "message_id", "period", "status",
    "reference_id", "message_date", "sender_name",
]


def names(ddl: str) -> list[str]:
    """Column names of a DDL string."""
    return [column.split()[0] for column in ddl.split(",")]
