"""Text body of a message: part choice, transfer decoding, charset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listmill.functions.text import (
    FIELD,
    after_header,
    header_block,
    header_lines,
    header_text,
    let,
)

_STATE = "struct<open:array<string>,text:string,encoding:string,in_text:boolean>"

# The headers of parts that carry a whole mail, any number deep. A delivery report is
# no such mail.
_OTHER_FIELD = rf"(?!content-type:){FIELD}"
_CARRIER = (
    rf"(?i)^(?:(?=(?:{_OTHER_FIELD})*+content-type:\s*message/(?!delivery-status))"
    rf"(?:{FIELD})*+\r?\n)*+"
)


def content_type(lines: Column) -> Column:
    """Lower-case media type; '' when absent or malformed, which means plain text."""
    value = header_text(lines, "content-type")
    return F.lower(F.regexp_extract(value, r"^\s*([^/;]*/[^/;]*?)\s*(?:;|$)", 1))


def is_plain_text(kind: Column) -> Column:
    return kind.isin("", "text/plain")


def boundary(lines: Column) -> Column:
    """Boundary parameter of the content type, '' when there is none."""
    given = F.regexp_extract(
        header_text(lines, "content-type"), r"""(?i);\s*boundary\s*=\s*("[^"]*"|[^\s;"]*)""", 1
    )
    return F.rtrim(F.replace(given, F.lit('"')))


def transfer_encoding(lines: Column) -> Column:
    return F.lower(F.trim(header_text(lines, "content-transfer-encoding")))


def bytes_to_text(data: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def from_base64(payload: Column) -> Column:
    """Lenient base64: foreign characters and a dangling last one are ignored."""
    code = F.regexp_replace(F.regexp_replace(payload, r"=[\s\S]*", ""), r"[^A-Za-z0-9+/]+", "")
    return F.unbase64(F.regexp_replace(code, r"^((?:.{4})*+).\z", "$1"))


def from_quoted_printable(payload: Column) -> Column:
    """Quoted-printable to bytes.

    Each ``=XX`` becomes the percent form of the UTF-8 encoding of U+00XX; the decoded
    text is then written as Latin-1, which gives back one byte per code.
    """
    text = F.replace(F.replace(payload, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B"))
    text = F.replace(text, F.lit("=="), F.lit("%3D"))
    text = F.regexp_replace(text, r"=\r?\n", "")
    text = F.regexp_replace(text, r"=([0-7][0-9A-Fa-f])", "%$1")
    text = F.regexp_replace(text, r"=([89ABab][0-9A-Fa-f])", "%C2%$1")
    for upper, lower in (("[Cc]", "8"), ("[Dd]", "9"), ("[Ee]", "A"), ("[Ff]", "B")):
        text = F.regexp_replace(text, rf"={upper}([0-9A-Fa-f])", f"%C3%{lower}$1")
    return F.encode(F.try_url_decode(text), "ISO-8859-1")


def decode_payload(payload: Column, encoding: Column) -> Column:
    """Undo the transfer encoding, then the charset; other payloads are text as they are."""
    return (
        F.when(encoding == "base64", bytes_to_text(from_base64(payload)))
        .when(encoding == "quoted-printable", bytes_to_text(from_quoted_printable(payload)))
        .otherwise(payload)
    )


def _delimiters(raw: Column) -> Column:
    """Regex for a line break in front of any delimiter line the message declares."""
    declared = F.array_union(
        F.regexp_extract_all(raw, F.lit(r'(?i)boundary\s*=\s*"([^"\n]+)"'), F.lit(1)),
        F.regexp_extract_all(raw, F.lit(r'(?i)boundary\s*=\s*([^\s;"]+)'), F.lit(1)),
    )
    escaped = F.transform(declared, lambda b: F.regexp_replace(F.rtrim(b), r"([^A-Za-z0-9])", r"\\$1"))
    return F.concat(
        F.lit(r"\r?\n(?=--(?:"), F.array_join(escaped, "|"), F.lit(r")(?:--)?[ \t]*\r?(?:\n|\z))")
    )


def _described(piece: Column, i: Column) -> Column:
    """A piece to the name on its delimiter line and its type, encoding and content."""
    line = F.rtrim(F.substring_index(piece, "\n", 1), F.lit(" \t\r"))
    rest = F.when(i == 0, piece).otherwise(F.regexp_extract(piece, r"^[^\n]*\n([\s\S]*)", 1))

    def fields(text: Column, head: Column, lines: Column, kind: Column) -> Column:
        report = kind == "message/delivery-status"
        inner = F.filter(F.array(boundary(lines)), lambda b: b != "")
        return F.struct(
            F.when(i > 0, F.substr(line, F.lit(3))).alias("name"),
            (report | is_plain_text(kind)).alias("is_text"),
            F.when(F.startswith(kind, F.lit("multipart/")), inner)
            .otherwise(F.array().cast("array<string>"))
            .alias("inner"),
            transfer_encoding(lines).alias("encoding"),
            F.when(report, "").otherwise(after_header(text, head)).alias("content"),
            piece.alias("piece"),
        )

    def read(text: Column, head: Column, lines: Column) -> Column:
        return let(content_type(lines), lambda kind: fields(text, head, lines, kind))

    return let(
        F.regexp_replace(rest, _CARRIER, ""),
        lambda text: let(
            header_block(text),
            lambda head: let(header_lines(head), lambda lines: read(text, head, lines)),
        ),
    )


def _last_text_leaf(raw: Column) -> Column:
    """Walk the delimiter lines and keep the last text/plain leaf.

    ``open`` holds the boundaries in force, outermost first. A delimiter line of a
    boundary that is not in force is ordinary text. A mail inside a mail counts by its
    own headers, the blocks of a delivery report count as empty text.
    """

    def step(state: Column, part: Column) -> Column:
        name, now = part["name"], state["open"]
        depth = F.coalesce(F.array_position(now, name), F.lit(0)).cast("int")
        end = F.array_position(now, F.regexp_extract(name, "^(.*)--$", 1)).cast("int")
        opens = name.isNull() | (depth > 0)
        closes = ~opens & (end > 0)
        goes_on = ~opens & ~closes & state["in_text"]
        begins = opens & part["is_text"]
        return F.struct(
            F.when(opens, F.concat(F.slice(now, F.lit(1), depth), part["inner"]))
            .when(closes, F.slice(now, F.lit(1), end - 1))
            .otherwise(now)
            .alias("open"),
            F.when(begins, part["content"])
            .when(goes_on, F.concat(state["text"], F.lit("\n"), part["piece"]))
            .otherwise(state["text"])
            .alias("text"),
            F.when(begins, part["encoding"]).otherwise(state["encoding"]).alias("encoding"),
            (begins | goes_on).alias("in_text"),
        ).cast(_STATE)

    def finish(state: Column) -> Column:
        # Parts that the message never closes lose the line break it ends with.
        unclosed = state["in_text"] & (F.size(state["open"]) > 0)
        text = F.when(unclosed, F.regexp_replace(state["text"], r"\r?\n\z", "")).otherwise(state["text"])
        return F.struct(text.alias("text"), state["encoding"].alias("encoding"))

    start = F.struct(
        F.array().cast("array<string>").alias("open"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("encoding"),
        F.lit(False).alias("in_text"),
    ).cast(_STATE)
    return F.aggregate(F.transform(F.split(raw, _delimiters(raw)), _described), start, step, finish)


def text_part(raw: Column, head: Column, kind: Column, encoding: Column) -> Column:
    """Still encoded text of a message: ``text`` and ``encoding``, text null for none.

    It is the only body, or the last text/plain leaf of the parts. ``kind`` and
    ``encoding`` are those of the message itself. A single part takes no lambda.
    """
    single = F.struct(
        F.when(is_plain_text(kind), after_header(raw, head)).alias("text"),
        encoding.alias("encoding"),
    )
    return F.when(F.rlike(kind, F.lit("^(?:multipart|message)/")), _last_text_leaf(raw)).otherwise(single)
