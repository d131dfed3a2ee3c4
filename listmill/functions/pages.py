"""Rows out of saved HTML pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from listmill.functions.text import let

# Project names whose identifier differs from the name (fixed values).
PROJECT_IDS = {
    "zetacomponents": "zeta",
    "hadoopdevelopmenttools(hdt)": "hdt",
    "climatemodeldiagnosticanalyzer": "cmda",
    "openofficeorg": "openoffice",
    "openoffice.org": "openoffice",
    "openclimateworkbench": "climate",
    "empire-db": "empire",
    "beanvalidation": "bval",
    "amber": "oltu",
    "lucene.net": "lucenenet",
    "xmlbeanscxx": "xmlbeans-cxx",
    "odftoolkit": "odf",
}

# Project states, in the order of the sections of the project page (fixed values).
STATUSES = ["incubating", "graduated", "retired"]

# Marks of the saved pages (fixed values).
PROJECT_HEADER = "<th>Project</th>"
ATTIC_HEADING = "Projects in the Attic"
PROJECT_SITE = "http://incubator.apache.org"


def project_id(name: Column) -> Column:
    """Identifier of a project name; most are their own."""
    pairs = [F.lit(x) for pair in PROJECT_IDS.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name)


def status_name(code: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in STATUSES]), code + 1)


def tags(html: Column, tag: str) -> Column:
    """All elements called ``tag``, outer text; elements must not nest in themselves."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"), F.lit(0))


# Entities that have names (fixed values); all others are decoded in their numeric forms.
_NAMED = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…",
    "agrave": "à", "aacute": "á", "auml": "ä", "ccedil": "ç", "egrave": "è", "eacute": "é", "iacute": "í",
    "ntilde": "ñ", "oacute": "ó", "ouml": "ö", "szlig": "ß", "uacute": "ú", "uuml": "ü",
}
_NUMERIC = r"&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"


def _character(entity: Column) -> Column:
    """What ``&#233;`` or ``&#xE9;`` stands for; one out of range stays as it is."""
    digits = F.regexp_extract(entity, r"&#[xX]?([0-9A-Fa-f]+);", 1)
    code = F.when(F.rlike(entity, F.lit("^&#[xX]")), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def inner_text(element: Column) -> Column:
    """Text of an element: tags removed, numeric and common named entities decoded."""

    def decoded(text: Column) -> Column:
        for name, character in _NAMED.items():
            text = F.replace(text, F.lit(f"&{name};"), F.lit(character))
        return let(text, numeric)

    def numeric(text: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(_NUMERIC), F.lit(0)))
        text = F.aggregate(found, text, lambda s, e: F.replace(s, e, _character(e)))
        return F.replace(text, F.lit("&amp;"), F.lit("&"))

    def shortcut(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("&")), decoded(text)).otherwise(text)

    return let(F.regexp_replace(element, r"<[^>]*>", ""), shortcut)


def attribute(element: Column, name: str) -> Column:
    """Value of an attribute in the element's opening tag, null when it has none."""
    opening = F.regexp_extract(element, r"^<[^>]*>", 0)
    pair = F.regexp_substr(opening, F.lit(rf"(?i)\s{name}\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"))
    return F.trim(F.regexp_replace(pair, r"^[^=]*=\s*", ""), F.lit("\"'"))


def first_quoted(element: Column) -> Column:
    """First double-quoted text of an element."""
    return F.regexp_extract(element, r'"([^"]*)"', 1)


def link_id(item: Column) -> Column:
    """Identifier in a list item's link: before ``.html``, after the last slash."""
    return F.substring_index(F.substring_index(item, ".html", 1), "/", -1)


def attic_items(html: Column) -> Column:
    """List items of the block under the attic heading."""
    block = F.regexp_extract(html, rf"(?s){ATTIC_HEADING}.*?</ul>", 0)
    return tags(block, "li")


def span_ids(html: Column) -> Column:
    """The ``id`` of every span: the months of a list's index page."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<span\b[^>]*?\sid="([^"]+)"'), F.lit(1))
