"""File changes out of commit notices.

Both notices are cut into sections by one left-to-right regex scan; a section swallows
everything that belongs to it, so header words inside an open diff start nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listmill.functions.text import unix_lines

CHANGE = "struct<file_path:string,file_op:string,addlines:int,dellines:int>"
CHANGES = f"array<{CHANGE}>"

# A list of indented paths, or a diff: header line, lines up to the ruler, then lines
# up to an empty line that is followed by a letter.
_SVN_SECTION = (
    r"(?md)^(?:"
    r"(?:Removed|Added):[ \t]*(?:\n [^\n]*)++"
    r"|(?:Modified|Added|Copied): [^\n]*(?:\n(?!=)[^\n]*)*+"
    r"(?:\n=[^\n]*(?:\n(?!\n\p{L})[^\n]*)*+)?"
    r")"
)
_GIT_SECTION = r"(?md)^https?:/[^\n]*(?:\n(?!https?:/)[^\n]*)*+"
# A section up to the two lines that name the old and the new file.
_GIT_NAMES = (
    r"\A(?:(?!diff -)[^\n]*\n)*+diff -[^\n]*(?:\n(?!--- )[^\n]*)*+\n--- [^\n]*\n[^\n]*"
)


def added_lines(lines: Column) -> Column:
    """How many lines begin with one plus sign."""
    return _signed(lines, "+")


def removed_lines(lines: Column) -> Column:
    """How many lines begin with one minus sign."""
    return _signed(lines, "-")


def _signed(lines: Column, sign: str) -> Column:
    return F.size(
        F.filter(lines, lambda l: F.startswith(l, F.lit(sign)) & ~F.startswith(l, F.lit(sign * 2)))
    )


def _change(path: Column, op: Column, added: Column, removed: Column) -> Column:
    return F.struct(
        F.replace(path, F.lit("\r"), F.lit("")).alias("file_path"), op.alias("file_op"), added.alias("addlines"), removed.alias("dellines")
    )


def _svn_list(lines: Column, kind: Column) -> Column:
    """Indented paths, without the notes that say where a directory came from."""
    op = F.when(kind == "Removed", "remove").otherwise("copy")
    paths = F.filter(
        lines, lambda l: F.startswith(l, F.lit(" ")) & ~F.rlike(l, F.lit(r"^ +- copied from"))
    )
    return F.transform(paths, lambda l: _change(F.substr(l, F.lit(5)), op, F.lit(0), F.lit(0)))


def _svn_diff(lines: Column, kind: Column) -> Column:
    name = F.substr(F.get(lines, 0), F.length(kind) + 3)
    path = F.when(kind == "Copied", F.substring_index(name, " ", 1)).otherwise(name)
    op = F.when(kind == "Modified", "mod").when(kind == "Copied", "copy").otherwise("add")
    removed = F.when(kind == "Added", 0).otherwise(removed_lines(lines))
    return F.array(_change(path, op, added_lines(lines), removed))


def svn_changes(body: Column) -> Column:
    """SVN notice to an array of changes, in the order of the text."""
    sections = F.regexp_extract_all(unix_lines(body), F.lit(_SVN_SECTION), F.lit(0))

    def expand(lines: Column) -> Column:
        title = F.get(lines, 0)
        kind = F.substring_index(title, ":", 1)
        is_list = F.rlike(title, F.lit(r"^\w+:[ \t]*$"))
        return F.when(is_list, _svn_list(lines, kind)).otherwise(_svn_diff(lines, kind))

    return F.flatten(F.transform(F.transform(sections, lambda s: F.split(s, "\n")), expand)).cast(CHANGES)


def file_operation(old: Column, new: Column) -> Column:
    """Operation told by the two names of a Git diff, first letter already cut."""
    old, new = F.rtrim(old, F.lit("\r")), F.rtrim(new, F.lit("\r"))
    return (
        F.when(old == new, "mod")
        .when(old == "dev/null", "add")
        .when(new == "dev/null", "del")
        .otherwise("copy")
    )


def git_changes(body: Column) -> Column:
    """Git notice to an array of changes: one per file address that has a diff."""
    sections = F.regexp_extract_all(unix_lines(body), F.lit(_GIT_SECTION), F.lit(0))
    named = F.transform(
        sections, lambda s: F.struct(F.regexp_extract(s, _GIT_NAMES, 0).alias("names"), s.alias("text"))
    )
    parts = F.transform(
        F.filter(named, lambda s: s["names"] != ""),
        lambda s: F.struct(
            F.split(s["names"], "\n").alias("names"),
            F.split(F.substr(s["text"], F.length(s["names"]) + 1), "\n").alias("lines"),
        ),
    )

    def change(part: Column) -> Column:
        names, lines = part["names"], part["lines"]
        name = lambda at: F.substr(F.element_at(names, at), F.lit(6))
        path = F.regexp_replace(F.get(names, 0), r"^https?:/.?", "")
        return _change(
            path, file_operation(name(-2), name(-1)), added_lines(lines), removed_lines(lines)
        )

    return F.transform(parts, change).cast(CHANGES)


def git_author_date(text: Column) -> Column:
    return F.coalesce(_line_value(text, "AuthorDate"), _line_value(text, "Authored"), F.lit(""))


def git_commit_date(text: Column) -> Column:
    return F.coalesce(_line_value(text, "Committed"), F.lit(""))


def git_revision(text: Column) -> Column:
    return F.coalesce(_line_value(text, "X-Git-Rev"), _line_value(text, "Commit"), F.lit(""))


def _line_value(text: Column, name: str) -> Column:
    line = F.regexp_substr(text, F.lit(rf"\n{name}: [^\n]*"))
    return F.rtrim(F.substring(line, F.lit(len(name) + 4), F.length(line)), F.lit("\r"))
