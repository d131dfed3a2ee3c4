"""Text cleaning and header access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A header block: an optional envelope line, then fields and their folded lines, then
# the empty line. Possessive repeats keep the match iterative however long the block is.
FIELD = r"(?:[!-9;-~]*:|[\t ])[^\n]*(?:\n|\z)"
_HEAD = rf"^(?:From [^\n]*\n)?(?:{FIELD})*+(?:\r?\n)?"

# The fields that any column is derived from (fixed values).
_FIELDS = (
    "message-id|from|to|cc|subject|date|in-reply-to|x-mailer|x-git-[!-9;-~]*"
    "|content-type|content-transfer-encoding"
)
_WANTED = rf"(?imd)^(?:{_FIELDS}):[^\n]*(?:\n[ \t][^\n]*)*+"


def strip_non_ascii(c: Column) -> Column:
    """Delete every byte above 0x7F; also right for text that is not valid UTF-8.

    Valid text with as many characters as bytes is ASCII already and takes no regex.
    """
    is_ascii = (F.octet_length(c) == F.length(c)) & F.is_valid_utf8(c)
    return F.when(is_ascii, c).otherwise(F.regexp_replace(c, r"[^\x00-\x7F]+", ""))


def unix_lines(c: Column) -> Column:
    pair = F.lit("\r\n")
    return F.when(F.contains(c, pair), F.replace(c, pair, F.lit("\n"))).otherwise(c)


def flatten_whitespace(c: Column) -> Column:
    """Newlines and tabs become semicolons."""
    return F.translate(c, "\n\t", ";;")


def header_block(raw: Column) -> Column:
    """The header block of a message and the empty line behind it."""
    return F.regexp_extract(raw, _HEAD, 0)


def after_header(raw: Column, head: Column) -> Column:
    return F.substr(raw, F.length(head) + 1)


def header_lines(head: Column) -> Column:
    """The wanted fields only, unfolded, one per line.

    One pass over the block; the single-field look-ups then scan a short text.
    """
    picked = F.array_join(F.regexp_extract_all(head, F.lit(_WANTED), F.lit(0)), "\n")
    return F.regexp_replace(picked, r"\r|\n(?=[ \t])", "")


def header(lines: Column, name: str) -> Column:
    """First field called ``name`` in any case, null when there is none."""
    value = F.regexp_substr(lines, F.lit(rf"(?imd)(?<=^{name}):[^\n]*"))
    return F.regexp_replace(value, r"^:[ \t]*", "")


def header_text(lines: Column, name: str) -> Column:
    """Like ``header``, but '' when there is none; each input is evaluated once."""
    value = F.regexp_extract(lines, rf"(?imd)(?<=^{name}):[^\n]*", 0)
    return F.regexp_replace(value, r"^:[ \t]*", "")


def has_header_prefix(lines: Column, prefix: str) -> Column:
    return F.rlike(lines, F.lit(rf"(?imd)^{prefix}"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Name a value inside a lambda so that it is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
