"""Queries over catalogue pages, manifests and archive keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.functions import pages
from listmill.operators import catalogue, manifest
from listmill.operators.projects import with_attic_flag
from listmill.schemas import PROJECTS, names
from listmill.scratch import shared_folder
from listmill.sources import manifest as manifest_io
from listmill.sources.saved_pages import read_pages
from listmill.workloads.mails import table, words

# Suppliers per made-up page; keys are unique, so a page holds no more.
PAGE = 500


def list_links(spark: SparkSession, sf: str) -> DataFrame:
    """List items of every web page with their address and the id in it."""
    items = table(spark, sf, "pages").select(
        "page_id", F.posexplode(pages.tags(F.col("html"), "li")).alias("pos", "item")
    )
    item = F.col("item")
    return items.select(
        "page_id",
        "pos",
        pages.attribute(F.get(pages.tags(item, "a"), 0), "href").alias("href"),
        pages.link_id(item).alias("link_id"),
    )


def _project_name() -> Column:
    """Every fifteenth name is one whose id differs."""
    special = F.array(*[F.lit(n) for n in pages.PROJECT_IDS])
    key = F.col("s_suppkey")
    return F.coalesce(F.get(special, (key % 15).cast("int")), words("proj", key))


def attic_flag(spark: SparkSession, sf: str) -> DataFrame:
    projects = table(spark, sf, "supplier").select(
        "s_suppkey", pages.project_id(_project_name()).alias("id")
    )
    size = F.col("p_size")
    attic = table(spark, sf, "part").select(
        F.when(size > 40, words("proj", F.col("p_partkey"))).when(size == 7, "zeta").when(size == 8, "odf").alias("id")
    )
    flagged = with_attic_flag(projects, attic.filter(F.col("id").isNotNull()))
    return flagged.select("s_suppkey", "id", "in_attic")


def _pages_of(rows: DataFrame, number: Column, order: Column, piece: Column, wrap) -> DataFrame:
    """Pieces of at most ``PAGE`` unique keys put together to one page."""
    gathered = rows.select(number.alias("number"), F.struct(order.alias("o"), piece.alias("p")).alias("entry"))
    entries = gathered.groupBy("number").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    return entries.select("number", wrap(F.col("entries")).alias("value"))


def _save_pages(spark: SparkSession, saved: DataFrame) -> str:
    """One file per page."""
    path = shared_folder(spark, "pages")
    saved.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Project pages of suppliers, saved as files and read back with their attic flag."""
    key = F.col("s_suppkey")
    day = lambda shift: F.date_format(F.date_add(F.lit("2005-01-01").cast("date"), (key % 3000 + shift).cast("int")), "yyyy-MM-dd")
    name = words("proj", key)
    row = words(
        '<tr id="', name, '"><td><a href="/projects/', name, '.html">', F.col("s_name"), "</a></td><td>about &lt;",
        key, "&gt;</td><td>Sponsor ", F.col("s_nationkey"), "</td><td>c</td><td>", day(0), "</td><td>", day(90), "</td></tr>\n",
    )
    header = f"<tr>{pages.PROJECT_HEADER}<th>Description</th></tr>\n"

    def wrap(entries: Column) -> Column:
        def section(code: int) -> Column:
            rows = F.filter(entries, lambda e: e["o"] % 3 == code)
            return F.array_join(F.transform(rows, lambda e: e["p"]), "")

        return words("<html><body><table>\n", header, section(0), header, section(1), header, section(2), "</table></body></html>")

    suppliers = table(spark, sf, "supplier")
    project_page = _save_pages(spark, _pages_of(suppliers, F.floor(key / PAGE), key, row, wrap))
    attic = suppliers.filter("s_acctbal < 0").select(
        words("<h6>", pages.ATTIC_HEADING, "</h6><ul><li><a href=\"https://h/projects/", name, ".html\">x</a></li></ul>").alias("html")
    )
    return catalogue.projects(read_pages(spark, project_page), attic)


def label_fill(spark: SparkSession, sf: str) -> DataFrame:
    """List index pages: a label per supplier, two lists each, then the months of each list's page."""
    key = F.col("s_suppkey")
    piece = words(
        "<h3>x</h3><ul><li><a name=\"", F.col("s_name"), "\">label</a>: <a href='http://h/", key,
        "-dev/'>dev</a></li></ul>\n<h3>y</h3><ul><li><a href=\"http://h/", key, "-commits/\">commits</a></li></ul>\n",
    )
    saved = _pages_of(
        table(spark, sf, "supplier"), F.floor(key / PAGE), key, piece,
        lambda entries: words("<html><a href='/top'>top</a>", F.array_join(F.transform(entries, lambda e: e["p"]), ""), "</html>"),
    )
    lists = catalogue.list_rows(saved.select(F.col("value").alias("html")))
    number = F.regexp_extract("list_url", r"(\d+)", 1).cast("int") % 3 + 1
    months = F.transform(
        F.sequence(F.lit(1), number), lambda m: words('<span class="s" id="20190', m, '">m</span>')
    )
    index_pages = lists.select("list_url", F.array_join(months, "\n").alias("html"))
    target = shared_folder(spark, "manifest")
    manifest_io.write_manifest(catalogue.manifest_rows(lists, index_pages), target)
    return manifest_io.read_manifest(spark, target)


def _list_of(number: Column) -> Column:
    return F.when(number % 2 == 0, "dev").otherwise("commits")


def _manifest_and_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A manifest of orders, through text, and the files of returned line items."""
    path = shared_folder(spark, "manifest")
    order = F.col("o_orderkey")
    manifest_io.write_manifest(
        table(spark, sf, "orders").select(
            words("c", F.col("o_custkey") % 100).alias("project"),
            _list_of(F.col("o_custkey")).alias("folder"),
            words("http://h/a,b/", order, ".mbox").alias("url"),
        ),
        path,
    )
    returned = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    customers = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    files = returned.join(customers, F.col("l_orderkey") == F.col("o_orderkey")).select(
        words("c", F.col("o_custkey") % 100).alias("project"),
        _list_of(F.col("o_custkey")).alias("folder"),
        words(F.col("l_orderkey"), ".mbox").alias("filename"),
    )
    return manifest_io.read_manifest(spark, path), files


def pending(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.pending(*_manifest_and_files(spark, sf))


def pending_progress(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.progress(*_manifest_and_files(spark, sf))


def rekey_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    part, supp = F.col("p_partkey"), F.col("s_suppkey")
    base = table(spark, sf, "part").select(
        words("p-", part % 50).alias("project"),
        _list_of(part).alias("folder"),
        words(part, ".mbox").alias("filename"),
        words("base ", part).alias("content"),
    )
    nested = table(spark, sf, "supplier").select(
        F.when(supp % 7 == 0, words("plain", supp)).otherwise(words("p-", supp * 3 % 50, "-", _list_of(supp))).alias("nested_key"),
        words(supp * 3, ".mbox").alias("filename"),
        F.when(supp % 5 == 0, "").otherwise(words("nested ", supp)).alias("content"),
    )
    taken = nested.transform(manifest.drop_empty).transform(manifest.split_nested)
    return manifest.overwrite_union(base, taken)


QUERIES = {
    "list_links": list_links,
    "attic_flag": attic_flag,
    "table_rows": table_rows,
    "label_fill": label_fill,
    "pending": pending,
    "pending_progress": pending_progress,
    "rekey_overwrite": rekey_overwrite,
}

_SPECIAL = ", ".join(f"'{i}'" for i in pages.PROJECT_IDS.values())
_PENDING = """
  SELECT 'c' || (o_custkey % 100) AS project, CASE WHEN o_custkey % 2 = 0 THEN 'dev' ELSE 'commits' END AS folder, 'http://h/a,b/' || o_orderkey || '.mbox' AS url,
         o_orderkey || '.mbox' AS filename
  FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = o_orderkey)
"""

ORACLES = {
    "list_links": """
        WITH items AS (
          SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li>.*?</li>')) AS item,
                 generate_subscripts(regexp_extract_all(html, '(?s)<li>.*?</li>'), 1) - 1 AS n FROM pages)
        SELECT page_id, n::INT AS pos, regexp_extract(item, 'href="([^"]*)"', 1) AS href,
               list_extract(string_split(string_split(item, '.html')[1], '/'), -1) AS link_id FROM items""",
    "attic_flag": f"""
        WITH attic AS (
          SELECT CASE WHEN p_size > 40 THEN 'proj' || p_partkey WHEN p_size = 7 THEN 'zeta' WHEN p_size = 8 THEN 'odf' END AS id
          FROM part)
        SELECT s_suppkey, id, id IN (SELECT id FROM attic WHERE id IS NOT NULL) AS in_attic
        FROM (SELECT s_suppkey, coalesce(list_extract([{_SPECIAL}], (s_suppkey % 15)::INT + 1), 'proj' || s_suppkey) AS id
              FROM supplier)""",
    "table_rows": f"""
        SELECT {", ".join(names(PROJECTS))} FROM (
          SELECT 'proj' || s_suppkey AS id, s_name AS name, (s_suppkey % 3)::INT AS status,
                 'Sponsor ' || s_nationkey AS sponsor,
                 DATE '2005-01-01' + (s_suppkey % 3000)::INT AS start_date,
                 CASE WHEN s_suppkey % 3 > 0 THEN DATE '2005-01-01' + (s_suppkey % 3000 + 90)::INT END AS end_date,
                 0 AS has_dev, 0 AS has_commit, s_acctbal < 0 AS in_attic,
                 'about <' || s_suppkey || '>' AS intro,
                 'http://incubator.apache.org/projects/proj' || s_suppkey || '.html' AS url
          FROM supplier)""",
    "label_fill": """
        SELECT s_name AS project, list AS folder,
               'http://h/' || s_suppkey || '-' || list || '/20190' || m || '.mbox' AS url
        FROM supplier, (VALUES ('dev'), ('commits')) l(list), (VALUES (1), (2), (3)) t(m)
        WHERE m <= s_suppkey % 3 + 1""",
    "pending": _PENDING,
    "pending_progress": f"""
        SELECT (SELECT count(*) FROM orders) AS total,
               (SELECT count(*) FROM orders) - (SELECT count(*) FROM ({_PENDING})) AS completed,
               (SELECT count(*) FROM ({_PENDING})) AS remaining""",
    "rekey_overwrite": """
        WITH nested AS (
          SELECT 'p-' || (s_suppkey * 3 % 50) AS project,
                 CASE WHEN s_suppkey % 2 = 0 THEN 'dev' ELSE 'commits' END AS folder,
                 (s_suppkey * 3) || '.mbox' AS filename, 'nested ' || s_suppkey AS content
          FROM supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0),
        base AS (
          SELECT 'p-' || (p_partkey % 50) AS project,
                 CASE WHEN p_partkey % 2 = 0 THEN 'dev' ELSE 'commits' END AS folder,
                 p_partkey || '.mbox' AS filename, 'base ' || p_partkey AS content FROM part)
        SELECT * FROM nested
        UNION ALL
        SELECT * FROM base WHERE (project, folder, filename) NOT IN (SELECT project, folder, filename FROM nested)""",
}
