"""Mailbox addresses, authors and committers."""

from __future__ import annotations

from email.utils import parseaddr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listmill.functions.text import non_empty

_AUTHOR = r"\nAuthor: (.*?) <([^>\n]*)>"
_COMMITTER = r"\nCommitter: (.*?) <([^>\n]*)>"


@F.pandas_udf(T.StructType([T.StructField("name", T.StringType()), T.StructField("address", T.StringType())]))
def _parsed(values: pd.Series) -> pd.DataFrame:
    """Display name and address as the standard library's ``parseaddr`` reads them.

    Its fold over quoted strings, nested comments, groups and lists is the rule the
    archives were read by; Arrow hands it a batch of headers at a time.
    """
    pairs = [(None, None) if v is None else parseaddr(v) for v in values]
    return pd.DataFrame(pairs, columns=["name", "address"])


def mailbox_name(value: Column) -> Column:
    """Display name of a mailbox header: of ``Name <a>``, ``"Q, N" <a>``, ``a (N)`` and all
    other forms as ``email.utils.parseaddr`` gives it; '' when there is none, null for null."""
    return _parsed(value)["name"]


def mailbox_address(value: Column) -> Column:
    """Address of a mailbox header as ``parseaddr`` gives it; '' when there is none."""
    return _parsed(value)["address"]


def local_part(address: Column) -> Column:
    return F.substring_index(address, "@", 1)


def _person(name: Column, email: Column) -> Column:
    return F.struct(name.alias("name"), email.alias("email"))


def email_sender(name: Column, address: Column) -> Column:
    """Sender of a plain mail: the display name, else the local part."""
    return _person(F.coalesce(non_empty(name), local_part(address)), address)


def svn_author(name: Column, address: Column, text: Column) -> Column:
    """Author of an SVN notice, who is also the committer."""
    in_text = non_empty(F.regexp_extract(text, r"\nAuthor: ?(\S+)", 1))
    return _person(F.coalesce(non_empty(name), in_text, local_part(address)), address)


def _named(text: Column, pattern: str) -> Column:
    """Name and address on a line of a Git notice, null when there is no such line."""
    line = F.regexp_substr(text, F.lit(pattern))
    return F.when(
        line.isNotNull(),
        _person(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2)),
    )


def git_author(text: Column) -> Column:
    """Author named in a Git notice, null when it names none."""
    return _named(text, _AUTHOR)


def git_committer(author: Column, address: Column, text: Column) -> Column:
    """Committer named in a Git notice, else the mail's sender.

    A notice without an author falls back to the sender as well.
    """
    named = F.when(author.isNotNull(), _named(text, _COMMITTER))
    return F.coalesce(named, _person(local_part(address), address))
