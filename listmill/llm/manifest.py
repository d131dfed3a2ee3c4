"""Merkle manifest of a table (operator 12), built by sibling-shift self-joins.

Every row is a leaf. Per group (here: source) leaves are put in order and numbered; at every
level each node equijoins the nodes whose indices are its siblings (the slots of its run of
``FAN_OUT``, found by offsets from slot zero), so that every node learns the hashes left and
right of it, and the rows in slot zero emit the parents. Groups whose level holds one node
are finished: that node is the group's subroot. Subroots, numbered by group, make the upper
tree in the same way, up to the root.

Each node keeps what stands left and right of it; so a leaf's proof is the path of these
pairs from its level to the root, gathered top down by one equijoin per level, and a changed
leaf is folded back to a root with the original siblings in the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listmill.llm.common import documents, written

FAN_OUT = 16
#: Bits of ``monotonically_increasing_id`` that number rows within a partition.
_ROW_BITS = 33


def H(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' concatenation."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else its UTF-8 byte count, ``:`` and the value (integers in decimal)."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[str]) -> Column:
    return H(*[field(F.col(c)) for c in columns])


def _group_key(column: str) -> Column:
    """A non-null string that keeps null apart from every value, empty text included."""
    return F.concat(F.when(F.col(column).isNull(), "0").otherwise("1"), F.coalesce(F.col(column), F.lit("")))


def numbered(frame: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``frame`` with ``_lm_idx``: 0, 1, ... within each ``group`` in the given order.

    A global sort by range (no group in one task, a third of all rows in one group included),
    then each row's place from the counts of the partitions before it, then the place of the
    group's first row subtracted. The sorted rows are written first, so the numbers stay fixed
    if a task runs again. Rows equal in the whole order get consecutive numbers in any order.
    """
    mono = "_lm_mono"
    ordered = written(frame.orderBy(F.col(group), *order).withColumn(mono, F.monotonically_increasing_id()),
                      "manifest-sorted")
    part = F.shiftright(F.col(mono), _ROW_BITS)
    counts = ordered.groupBy(part.alias("_lm_part")).agg(F.count("*").alias("_lm_rows"))
    before = Window.orderBy("_lm_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per input partition: its size is bounded by the partition count, not by the rows.
    offsets = counts.select("_lm_part", F.coalesce(F.sum("_lm_rows").over(before), F.lit(0)).alias("_lm_off"))
    at = ordered.join(F.broadcast(offsets), part == F.col("_lm_part")).select(
        *[F.col(c) for c in frame.columns], "_lm_part",
        (F.col("_lm_off") + F.col(mono).bitwiseAND((1 << _ROW_BITS) - 1)).alias("_lm_at"))
    at = written(at, "manifest-at")
    # A group's first row, found per (partition, group) and joined back on both, so that the
    # rows of a group that fills many partitions stay spread over them.
    pieces = at.groupBy("_lm_part", group).agg(F.min("_lm_at").alias("_lm_first"),
                                                          F.count("*").alias("_lm_rows"))
    spans = pieces.groupBy(group).agg(F.min("_lm_first").alias("_lm_start"), F.sum("_lm_rows").alias("_lm_n"))
    starts = pieces.join(spans, group).select("_lm_part", group, "_lm_start", "_lm_n")
    return at.join(starts, ["_lm_part", group]).select(
        *frame.columns, (F.col("_lm_at") - F.col("_lm_start")).alias("_lm_idx"), "_lm_n")


def _level(nodes: DataFrame, fan_out: int) -> tuple[DataFrame, DataFrame]:
    """Nodes of a level with ``_lm_left`` and ``_lm_right``, and the parents their slot zero emits.

    ``nodes``: ``_lm_grp``, ``_lm_idx``, ``_lm_hash``, ``_lm_n`` (nodes of the group at this
    level, more than one). Each node asks for the indices of its run; one equijoin on
    (group, index) answers all of them.
    """
    slot = F.col("_lm_idx") % fan_out
    start = F.col("_lm_idx") - slot
    last = F.least(F.lit(fan_out - 1), F.col("_lm_n") - 1 - start)
    asks = nodes.select(
        "_lm_grp", F.col("_lm_idx").alias("_lm_of"), slot.alias("_lm_slot"), "_lm_n",
        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_lm_t"),
    ).withColumn("_lm_idx", F.col("_lm_of") - F.col("_lm_slot") + F.col("_lm_t"))
    answers = asks.join(nodes.select("_lm_grp", "_lm_idx", F.col("_lm_hash").alias("_lm_sib")),
                        ["_lm_grp", "_lm_idx"])
    run = F.array_sort(F.collect_list(F.struct("_lm_t", "_lm_sib")))
    runs = answers.groupBy("_lm_grp", "_lm_of", "_lm_slot", "_lm_n").agg(run.alias("_lm_run"))

    def joined(keep) -> Column:
        return F.array_join(F.transform(F.filter("_lm_run", keep), lambda x: x["_lm_sib"]), "")

    level = runs.select(
        "_lm_grp", F.col("_lm_of").alias("_lm_idx"), "_lm_n",
        F.get(F.col("_lm_run"), F.col("_lm_slot").cast("int"))["_lm_sib"].alias("_lm_hash"),
        joined(lambda x: x["_lm_t"] < F.col("_lm_slot")).alias("_lm_left"),
        joined(lambda x: x["_lm_t"] > F.col("_lm_slot")).alias("_lm_right"))
    level = written(level, "manifest-level")
    parents = level.where(F.col("_lm_idx") % fan_out == 0).select(
        "_lm_grp", (F.col("_lm_idx") / fan_out).cast("long").alias("_lm_idx"),
        H("_lm_left", "_lm_hash", "_lm_right").alias("_lm_hash"),
        F.ceil(F.col("_lm_n") / fan_out).cast("long").alias("_lm_n"))
    return level, parents


def _tree(nodes: DataFrame, fan_out: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels (with left and right) and the top of each group: ``_lm_grp``, ``_lm_top``, ``_lm_height``."""
    levels, tops, height = [], [], 0
    while True:
        nodes = written(nodes, "manifest-nodes")
        tops.append(nodes.where("_lm_n = 1").select(
            "_lm_grp", F.col("_lm_hash").alias("_lm_top"), F.lit(height).alias("_lm_height")))
        busy = nodes.where("_lm_n > 1")
        if busy.isEmpty():
            break
        level, nodes = _level(busy, fan_out)
        levels.append(level)
        height += 1
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return levels, top


def _paths(
    levels: list[DataFrame], top: DataFrame, top_paths: DataFrame, fan_out: int, last_written: bool = True,
) -> DataFrame:
    """Per node of the lowest level: its columns, ``_lm_path`` and ``_lm_sub`` (its group's top).

    ``_lm_path`` holds the (left, right) pairs from the node's level to the root.
    ``top_paths``: ``_lm_grp`` and the path above the group's top. A group whose top is at
    height h has its nodes of level h-1 below it, and so on down. Groups of one node only
    are not among them.
    """
    pair = F.struct(F.col("_lm_left").alias("left"), F.col("_lm_right").alias("right"))
    with_tops = top.join(top_paths, "_lm_grp").select("_lm_grp", "_lm_height", "_lm_path",
                                                      F.col("_lm_top").alias("_lm_sub"))
    above = None  # paths of the nodes one level up: _lm_grp, _lm_idx, _lm_path, _lm_sub
    for height in range(len(levels), 0, -1):
        level = levels[height - 1]
        # Parents of this level's nodes: tops of groups of this height, or nodes of the level above.
        parents = with_tops.where(F.col("_lm_height") == height).select(
            "_lm_grp", F.lit(0).cast("long").alias("_lm_up"), "_lm_path", "_lm_sub")
        if above is not None:
            parents = parents.unionByName(above.select(
                "_lm_grp", F.col("_lm_idx").alias("_lm_up"), "_lm_path", "_lm_sub"))
        own = [c for c in level.columns if c not in ("_lm_left", "_lm_right")]
        above = (level.withColumn("_lm_up", (F.col("_lm_idx") / fan_out).cast("long"))
                 .join(parents, ["_lm_grp", "_lm_up"])
                 .select(*own, F.concat(F.array(pair), "_lm_path").alias("_lm_path"), "_lm_sub"))
        if height > 1 or last_written:
            above = written(above, "manifest-paths")
    return above


def manifest(
    rows: DataFrame,
    columns: list[str] | None = None,
    group: str = "source",
    order: str = "doc_id",
    carry: list[str] | None = None,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """``carry`` columns of each row with ``leaf``, ``subroot``, ``root`` and ``path``.

    ``path`` is the array of (left, right) sibling text from the leaf's level to the root.
    The leaf is the SHA-256 (lowercase hex) of ``columns`` (default: all), each ``-`` if
    null, else its UTF-8 byte count, ``:`` and the value. Rows of a ``group`` ascend by
    ``order``, then by leaf (nulls first in both); rows equal in both are repeated leaves in
    some order. Every ``fan_out`` consecutive nodes, or fewer at the end of a level, even
    one, become the hash of their hashes' concatenation while a group has more than one
    node; the last is the subroot (a lone leaf itself). Subroots, by group with a null group
    first and the rest by UTF-8 bytes, make the root likewise. An empty table gives an empty
    result. ``carry`` (default: all columns but the four added) is all that the sort and the
    work tables hold of a row besides its keys, so texts need not go through them.
    """
    added = ["leaf", "subroot", "root", "path"]
    columns = columns or [c for c in rows.columns if not c.startswith("_lm_")]
    carry = carry or [c for c in rows.columns if c not in added and not c.startswith("_lm_")]
    leaves = rows.select(*carry, F.col(group).alias("_lm_g"), F.col(order).alias("_lm_o"),
                         leaf_of(columns).alias("_lm_leaf"), _group_key(group).alias("_lm_grp"))
    leaves = numbered(leaves, "_lm_grp", [F.col("_lm_o").asc_nulls_first(), F.col("_lm_leaf")])
    levels, top = _tree(leaves.select("_lm_grp", "_lm_idx", F.col("_lm_leaf").alias("_lm_hash"), "_lm_n"), fan_out)
    top = written(top, "manifest-tops")
    names = leaves.where("_lm_idx = 0").select("_lm_grp", "_lm_g")
    subroots = numbered(top.join(names, "_lm_grp").withColumn("_lm_one", F.lit(0)), "_lm_one",
                        [F.col("_lm_g").asc_nulls_first()])
    upper, root = _tree(subroots.select(F.col("_lm_one").cast("string").alias("_lm_grp"), "_lm_idx",
                                        F.col("_lm_top").alias("_lm_hash"), "_lm_n"), fan_out)
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    upper_paths = _paths(upper, root, root.select("_lm_grp", no_path.alias("_lm_path")), fan_out)
    if upper_paths is None:  # one group or none: its top is the root
        upper_paths = root.select(F.lit(0).cast("long").alias("_lm_idx"), no_path.alias("_lm_path"))
    top_paths = subroots.join(upper_paths.select(F.col("_lm_idx").alias("_lm_sub"), "_lm_path"),
                              F.col("_lm_idx") == F.col("_lm_sub")).select("_lm_grp", "_lm_path")
    # The row's columns go with its leaf through the lowest level and down the paths.
    carried = leaves.select("_lm_grp", "_lm_idx", *carry)
    if levels:
        levels[0] = written(levels[0].join(carried, ["_lm_grp", "_lm_idx"]), "manifest-leaves")
    leaf_paths = _paths(levels, top, top_paths, fan_out, last_written=False)
    lone = (top.where("_lm_height = 0").join(top_paths, "_lm_grp")
            .join(carried.where("_lm_idx = 0"), "_lm_grp")
            .select(*carry, F.col("_lm_top").alias("_lm_hash"), "_lm_path", F.col("_lm_top").alias("_lm_sub")))
    if leaf_paths is not None:
        lone = leaf_paths.select(*carry, "_lm_hash", "_lm_path", "_lm_sub").unionByName(lone)
    # The root is one value; a table without rows has none.
    the_root = root.select("_lm_top").first()
    keep = [c for c in carry if c not in added]
    return lone.select(*keep, F.col("_lm_hash").alias("leaf"), F.col("_lm_sub").alias("subroot"),
                       F.lit(the_root[0] if the_root else None).cast("string").alias("root"),
                       F.col("_lm_path").alias("path"))


def proof(path: Column) -> Column:
    """SHA-256 of the siblings along the path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` gives with the path's siblings."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]), 256))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered(frame: DataFrame) -> Column:
    """Where 5 divides the unsigned CRC-32 of the decimal doc_id, the text with A-Z lowered."""
    hit = (F.crc32(F.col("doc_id").cast("string")) % 5) == 0
    return F.when(hit, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*COLUMNS)
    changed = docs.withColumn("tampered_text", tampered(docs)).withColumn(
        "changed_leaf", leaf_of([c if c != "text" else "tampered_text" for c in COLUMNS]))
    built = manifest(changed, COLUMNS, carry=["doc_id", "changed_leaf"])
    return built.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        fold(F.col("changed_leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
