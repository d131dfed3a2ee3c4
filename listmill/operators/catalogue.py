"""Catalogue pages to project, attic and list rows.

A page is cut at its marks inside its own row, so that neither the running section
number nor the running label needs a window or an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listmill.functions import pages
from listmill.operators.projects import with_attic_flag
from listmill.schemas import PROJECTS, names

# A label is an anchor without an address.
_LABEL = r"(?is)(?=<a\b(?![^>]*\shref\s*=\s*[\"']?[^\s\"'>]))"


def _cell(row: Column, n: int) -> Column:
    return pages.inner_text(F.get(pages.tags(row, "td"), n))


def project_rows(saved: DataFrame) -> DataFrame:
    """Rows of the project page ``saved(html)``.

    The state of a project is the number of header rows above it, less one.
    """
    cut = F.split("html", rf"(?is)<tr\b[^>]*>\s*{pages.PROJECT_HEADER}")
    sections = saved.select(F.posexplode(cut).alias("section", "part"))
    rows = sections.filter("section > 0").select(
        (F.col("section") - 1).alias("status"), F.explode(pages.tags(F.col("part"), "tr")).alias("row")
    )
    row, anchor = F.col("row"), F.col("anchor")
    return (
        rows.filter(F.rlike(row, F.lit(r"(?i)<td\b")))
        .withColumn("anchor", F.get(pages.tags(row, "a"), 0))
        .select(
            pages.project_id(pages.first_quoted(row)).alias("id"),
            pages.inner_text(anchor).alias("name"),
            "status",
            _cell(row, 2).alias("sponsor"),
            F.try_to_date(_cell(row, 4), "yyyy-MM-dd").alias("start_date"),
            F.when(F.col("status") > 0, F.try_to_date(_cell(row, 5), "yyyy-MM-dd")).alias("end_date"),
            F.lit(0).alias("has_dev"),
            F.lit(0).alias("has_commit"),
            _cell(row, 1).alias("intro"),
            F.concat(F.lit(pages.PROJECT_SITE), pages.attribute(anchor, "href")).alias("url"),
        )
    )


def attic_ids(saved: DataFrame) -> DataFrame:
    """Identifiers listed on the attic page ``saved(html)``."""
    return saved.select(F.explode(pages.attic_items(F.col("html"))).alias("item")).select(
        pages.link_id(F.col("item")).alias("id")
    )


def projects(project_page: DataFrame, attic_page: DataFrame) -> DataFrame:
    """Project rows with their attic flag, in the ``PROJECTS`` schema."""
    return with_attic_flag(project_rows(project_page), attic_ids(attic_page)).select(*names(PROJECTS))


def list_rows(saved: DataFrame) -> DataFrame:
    """Lists of the index page ``saved(html)``: label, list name and address.

    Lists stand in the items under a heading. A label holds for all anchors up to the
    next label, also across headings; without one there is no project to file under.
    """
    blocks = F.split("html", r"(?i)<h3\b")
    items = F.transform(
        F.slice(blocks, F.lit(2), F.size(blocks)),
        lambda block: F.regexp_extract(block, r"(?is)<li\b.*</li>", 0),
    )
    segments = saved.select(F.explode(F.split(F.array_join(items, "\n"), _LABEL)).alias("segment"))
    label = F.regexp_extract("segment", r"(?is)^<a\b[^>]*\sname\s*=\s*[\"']?([^\s\"'>]+)", 1)
    anchors = segments.select(
        F.nullif(label, F.lit("")).alias("project"),
        F.explode(pages.tags(F.col("segment"), "a")).alias("anchor"),
    )
    return anchors.select(
        "project",
        pages.inner_text(F.col("anchor")).alias("folder"),
        pages.attribute(F.col("anchor"), "href").alias("list_url"),
    ).filter((F.col("list_url") != "") & F.col("project").isNotNull())


def manifest_rows(lists: DataFrame, index_pages: DataFrame) -> DataFrame:
    """One archive address per list and month.

    ``index_pages(list_url, html)`` are the saved index pages of the lists. Their months are
    read off before the join, so no page is exchanged.
    """
    months = index_pages.select("list_url", pages.span_ids(F.col("html")).alias("months"))
    joined = lists.join(months, "list_url").select("project", "folder", "list_url", F.explode("months").alias("month"))
    return joined.select("project", "folder", F.concat("list_url", "month", F.lit(".mbox")).alias("url"))
