"""Merkle fixity audit of record archives (operator 1).

Records of archive files are hashed; a file's records, in order of their offsets, fall into
offset ranges, and ranges into wider ranges, up to one root per file. Two replicas with
equal roots are equal. Where roots differ, only the children of differing nodes are looked
at, level by level, down to the records that are damaged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listmill.llm.common import text_of, written

#: Bytes of the ranges at the lowest level, and how many ranges make one of the next.
RANGE_BYTES, FANOUT = 65_536, 8
#: Records that the query packs into one archive file.
FILE_RECORDS = 256


def leaves(records: DataFrame, replica: str) -> DataFrame:
    """One row per record: ``replica``, ``file``, ``at``, ``size``, ``id``, ``digest``.

    ``records``: ``file``, ``at`` (offset), ``size`` (bytes), ``id``, ``content``. Contents are
    hashed where they are read; nothing wide is exchanged.
    """
    return records.select(
        F.lit(replica).alias("replica"), "file", "at", "size", "id", F.sha2("content", 256).alias("digest"))


def _node(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def tree(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Nodes by level, lowest first: ``file``, ``place``, ``a``, ``b`` (digests of the replicas).

    The last level has one node per file. A node's digest covers its children in order; a
    range without records has no node. Both replicas' nodes come from one aggregation.
    """
    low = records.groupBy("replica", "file", F.floor(F.col("at") / range_bytes).alias("place")).agg(
        _node(F.transform(
            F.sort_array(F.collect_list(F.struct("at", "size", "digest"))),
            lambda x: F.concat_ws(":", x["at"], x["size"], x["digest"]))).alias("digest"))

    def paired(nodes: DataFrame) -> DataFrame:
        return written(nodes.groupBy("file", "place").agg(
            F.max(F.when(F.col("replica") == "a", F.col("digest"))).alias("a"),
            F.max(F.when(F.col("replica") == "b", F.col("digest"))).alias("b")), "nodes")

    levels = [paired(low)]
    top = levels[0].agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]
    while top > 0:
        sides = levels[-1].select("file", "place", F.explode(F.array(
            F.struct(F.lit("a").alias("replica"), F.col("a").alias("digest")),
            F.struct(F.lit("b").alias("replica"), F.col("b").alias("digest")))).alias("side"))
        up = sides.select("file", "place", "side.*").where("digest IS NOT NULL").groupBy(
            "replica", "file", F.floor(F.col("place") / fanout).alias("up")).agg(_node(F.transform(
                F.sort_array(F.collect_list(F.struct("place", "digest"))),
                lambda x: F.concat_ws(":", x["place"], x["digest"]))).alias("digest"))
        levels.append(paired(up.withColumnRenamed("up", "place")))
        top //= fanout
    return levels


def audit(
    first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT,
) -> DataFrame:
    """Records in which two replicas differ: ``file``, ``at``, ``id``, ``fault``, ``nodes_compared``.

    ``fault``: ``altered`` (same size, other content), ``resized``, ``lost`` (only in the
    first) or ``extra`` (only in the second). ``nodes_compared`` is how many nodes of the
    file's tree were compared on the way down. Replicas: ``file``, ``at``, ``size``, ``id``,
    ``content``. A null content is an empty one; rows with a null file or offset are compared
    like others, under file ``''`` and offset 0; of several records at one offset, pairs are
    compared in order of digest, so repeated rows in both replicas are no fault. Empty
    replicas give an empty result; one empty replica makes all records of the other
    faults.

    Exchanged are digests. The first exchange carries one row per record, later ones one per
    node; a range holds what fits into its bytes, a node at most ``fanout`` children.
    """
    def plain(records: DataFrame) -> DataFrame:
        return records.select(
            F.coalesce("file", F.lit("")).alias("file"), F.coalesce("at", F.lit(0)).cast("long").alias("at"),
            F.coalesce("size", F.lit(0)).cast("long").alias("size"), "id", F.coalesce("content", F.lit("")).alias("content"))

    records = written(leaves(plain(first), "a").unionByName(leaves(plain(second), "b")), "records")
    levels = tree(records, range_bytes, fanout)
    differing = levels[-1].where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "place")
    compared = levels[-1].join(differing.select("file"), "file", "left_semi").select("file", F.lit(1).alias("n"))
    for nodes in reversed(levels[:-1]):
        children = nodes.join(
            differing.select("file", F.col("place").alias("up")),
            (nodes["file"] == differing["file"]) & (F.floor(nodes["place"] / fanout) == F.col("up")), "left_semi")
        children = written(children, "descent")
        compared = compared.unionByName(children.groupBy("file").agg(F.count("*").cast("int").alias("n")))
        differing = children.where(~F.col("a").eqNullSafe(F.col("b"))).select("file", "place")
    ranges = differing.select(F.col("file").alias("f"), F.col("place").alias("p"))
    doubtful = records.join(
        ranges, (F.col("file") == F.col("f")) & (F.floor(F.col("at") / range_bytes) == F.col("p")), "left_semi")
    twin = Window.partitionBy("replica", "file", "at").orderBy("digest", "size", "id")
    pairs = doubtful.withColumn("twin", F.row_number().over(twin)).groupBy("file", "at", "twin").agg(
        *[F.max(F.when(F.col("replica") == r, F.struct("size", "digest", "id"))).alias(r) for r in "ab"])
    fault = (
        F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "extra")
        .when(F.col("a.size") != F.col("b.size"), "resized").when(F.col("a.digest") != F.col("b.digest"), "altered"))
    totals = compared.groupBy("file").agg(F.sum("n").cast("long").alias("nodes_compared"))
    return (
        pairs.withColumn("fault", fault).where("fault IS NOT NULL").join(totals, "file")
        .select("file", "at", F.coalesce("a.id", "b.id").alias("id"), "fault", "nodes_compared"))


def packed(pages: DataFrame, file_records: int = FILE_RECORDS) -> DataFrame:
    """Pages as records with ``file``, ``at``, ``size``, ``id``, ``content``, and page ``row``.

    A file takes a run of page ids, a record is a header with the url, and the page. A record
    begins where the ones with smaller ids end, so offsets are running sums of sizes. Pages
    without an id fill files of their own, by hashes of their urls.
    """
    content = F.concat(F.lit("WARC/1.1 response "), F.coalesce("url", F.lit("-")), F.lit("\r\n\r\n"), text_of("html"))
    number = F.coalesce(
        F.floor(F.col("page_id") / file_records), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(4096)))
    order = Window.partitionBy("file").orderBy("page_id", "url", F.xxhash64("content"))
    rows = pages.select(
        F.format_string("%08d.warc", number).alias("file"), "page_id", "url", content.alias("content"))
    rows = rows.withColumn("size", F.octet_length("content").cast("long"))
    return rows.withColumn("at", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).select(
        "file", "at", "size", F.col("page_id").alias("id"), "content")


def damaged(records: DataFrame) -> DataFrame:
    """A second replica with faults at fixed ids: flipped, cut and lost records."""
    middle = F.floor(F.char_length("content") / 2).cast("int")
    content = (
        F.when(F.col("id") % 97 == 13, F.overlay("content", F.lit("#"), middle + 1))
        .when(F.col("id") % 389 == 5, F.substring(F.col("content"), F.lit(1), middle))
        .otherwise(F.col("content")))
    return records.where("coalesce(id % 199 <> 7, true)").withColumn("content", content).withColumn(
        "size", F.octet_length("content").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = written(packed(spark.read.parquet(f"{sf_dir}/pages.parquet")), "replica")
    return audit(records, damaged(records)).select(
        F.col("id").alias("page_id"), "file", F.col("at").alias("byte_offset"), "fault", "nodes_compared")


SQL = r"""
WITH records AS (
  SELECT page_id, page_id // 256 AS n,
         'WARC/1.1 response ' || coalesce(url, '-') || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS content
  FROM pages),
placed AS (
  SELECT *, strlen(content) AS size,
         sum(strlen(content)) OVER (PARTITION BY n ORDER BY page_id) - strlen(content) AS pos FROM records),
replicas AS (
  SELECT *, CASE WHEN page_id % 97 = 13 THEN content[:length(content) // 2] || '#' || content[length(content) // 2 + 2:]
                 WHEN page_id % 389 = 5 THEN content[:length(content) // 2] ELSE content END AS other,
         page_id % 199 = 7 AS lost FROM placed),
faults AS (
  SELECT page_id, n, pos, CASE WHEN lost THEN 'lost' WHEN strlen(other) <> size THEN 'resized'
                              WHEN other <> content THEN 'altered' END AS fault FROM replicas),
counts AS (
  SELECT n, sum(c) AS nodes_compared FROM (
    SELECT n, 1 AS c FROM faults WHERE fault IS NOT NULL GROUP BY n
    UNION ALL
    SELECT p.n, count(DISTINCT p.place) FROM (
      SELECT DISTINCT n, lv, pos // 65536 // (8 ** lv)::BIGINT AS place FROM placed, range(0, 12) AS l(lv)) p
    JOIN (SELECT DISTINCT n, lv, pos // 65536 // (8 ** lv)::BIGINT AS place FROM faults, range(0, 13) AS l(lv)
          WHERE fault IS NOT NULL) f ON p.n = f.n AND f.lv = p.lv + 1 AND p.place // 8 = f.place
    WHERE p.lv < (SELECT count(*) FROM range(0, 12) AS l(lv)
                  WHERE (SELECT max(pos) // 65536 FROM placed) // (8 ** lv)::BIGINT > 0)
    GROUP BY p.n, p.lv) GROUP BY n)
SELECT page_id, printf('%08d.warc', n) AS file, pos::BIGINT AS byte_offset, fault, nodes_compared::BIGINT AS nodes_compared
FROM faults JOIN counts USING (n) WHERE fault IS NOT NULL
"""
