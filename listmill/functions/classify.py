"""Message classes: SVN notice, Git notice or plain mail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listmill.functions.text import non_empty


def class_from_headers(x_mailer: Column, has_git_header: Column, sender: Column) -> Column:
    """SVN for a mailer other than Git, Git for any Git header, else plain mail."""
    svn = non_empty(x_mailer).isNotNull() & ~F.contains(x_mailer, F.lit("Git"))
    return (
        F.when(svn, "SVN")
        .when(has_git_header, "Git")
        .when(sender.isNotNull(), "EMAIL")
    )


def class_from_subject(subject: Column) -> Column:
    """Replies are plain mail and ``svn ...`` subjects are SVN, whatever the headers."""
    return (
        F.when(F.length(subject) < 4, F.lit(None).cast("string"))
        .when(F.startswith(subject, F.lit("Re:")), "EMAIL")
        .when(F.startswith(subject, F.lit("svn ")), "SVN")
    )


def message_class(
    subject: Column, x_mailer: Column, has_git_header: Column, sender: Column
) -> Column:
    return F.coalesce(
        class_from_subject(subject), class_from_headers(x_mailer, has_git_header, sender)
    )


def settle_class(raw_class: Column, subject: Column, n_changes: Column) -> Column:
    """An SVN-classed mail without any change is plain mail unless its subject says svn."""
    says_svn = F.coalesce(F.startswith(subject, F.lit("svn ")), F.lit(False))
    stray = (raw_class == "SVN") & (n_changes == 0) & ~says_svn
    return F.when(stray, "EMAIL").otherwise(raw_class)
