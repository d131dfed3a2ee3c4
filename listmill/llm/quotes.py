"""Quotation linking (operator 8).

Messages quote what they answer. Quote levels are parsed, quoted passages normalised and
hashed, and joined to the earlier messages that wrote the passage themselves; one of them is
the message replied to. Following replies upwards gives conversations, in reply order and without the
quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listmill.llm.common import ship_with_jobs, text_of, written

ship_with_jobs(__name__)

#: Writers of one passage in a scope up to which each is a candidate, and places of a scope
#: that are searched together where there are more.
MANY, RANGE = 200, 4096

_MARKS = re.compile(r"(?:>[ \t]?)+")
# Lines that announce a quote, in the languages of the data.
_SAYS = re.compile(r".*\b(?:wrote|writes|said|schrieb|a écrit|escribió)[^:\n]*:[ \t]*")


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message without its quotes, and its passages as (quote level, lines).

    A passage is a run of lines at one level between empty lines. A line that announces the
    quote right below it belongs to the quote. Level 0 is the message's own text, which loses
    empty lines at its ends.
    """
    levels, bodies = [], []
    for line in text.split("\n"):
        m = _MARKS.match(line)
        levels.append(m.group().count(">") if m else 0)
        bodies.append(line[m.end():] if m else line)
    for i in range(len(levels) - 1):
        if levels[i] < levels[i + 1] and _SAYS.fullmatch(bodies[i]):
            levels[i] = -1
    own = "\n".join(b for n, b in zip(levels, bodies) if n == 0).strip("\n")
    passages, level, lines = [], 0, []
    for n, b in [*zip(levels, bodies), (0, "")]:
        if lines and (n != level or not b.strip()):
            passages.append((level, "\n".join(lines)))
            lines = []
        if n >= 0 and b.strip():
            level = n
            lines.append(b)
    return own, passages


def prints(passages: list[tuple[int, str]]) -> list[dict]:
    """Level, 128-bit hash and weight of each passage, and of each line of longer ones.

    Hashed is the lower-case text with single blanks; the weight is its length.
    """
    made = []
    for level, passage in passages:
        lines = passage.split("\n")
        for part in [passage, *lines] if len(lines) > 1 else lines:
            plain = " ".join(part.lower().split())
            digest = xxhash.xxh3_128_intdigest(plain)
            made.append({
                "level": level, "low": digest % 2**64 - 2**63, "high": (digest >> 64) - 2**63, "weight": len(plain)})
    return made


_PRINT = pa.struct([("level", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("weight", pa.int64())])
_PARSED = "_lm_scope bigint, _lm_seq bigint, own string, prints array<struct<level int, low bigint, high bigint, weight bigint>>"


def _parse_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owns, found = [], []
        for text in batch.column(2):
            own, passages = parse(text.as_py())
            owns.append(own)
            found.append(prints(passages))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(owns, pa.string()), pa.array(found, pa.list_(_PRINT))],
            ["_lm_scope", "_lm_seq", "own", "prints"])


def _last_before(writers: DataFrame, asked: DataFrame, key: list[str]) -> DataFrame:
    """``asked`` with ``writer``, the last one of its ``key`` before ``_lm_seq``, where there is one.

    Keys are cut into ranges of places, each of which takes over the last writer before it.
    """
    rows = asked.withColumns({"place": F.col("_lm_seq"), "w": F.lit(None).cast("long")}).unionByName(
        writers.select(*key, F.col("writer").alias("place"), F.col("writer").alias("w")), allowMissingColumns=True,
    ).withColumn("range", F.floor(F.col("place") / RANGE))
    over = rows.groupBy(*key, "range").agg(F.max("w").alias("top")).withColumn("over", F.max("top").over(
        Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("top")
    inside = F.max("w").over(Window.partitionBy(*key, "range").orderBy("place").rangeBetween(Window.unboundedPreceding, -1))
    return rows.join(over, [*key, "range"]).withColumn("writer", F.coalesce(inside, "over")).where(
        "_lm_seq IS NOT NULL AND writer IS NOT NULL").select(*asked.columns, "writer")


def _parents(prints_of: DataFrame, many: int) -> DataFrame:
    """``_lm_scope``, ``_lm_seq``, ``up``: the message that each reply answers.

    In: a row for each print with ``level``, ``low``, ``high``, ``weight``, ``quotes`` (whether
    its message quotes anything).
    """
    key, passage = ["_lm_scope", "_lm_seq"], ["_lm_scope", "low", "high"]
    writers = written(prints_of.where("level = 0").groupBy(*passage, F.col("_lm_seq").alias("writer")).agg(
        F.max("quotes").alias("quotes")), "writers")
    known = writers.groupBy(*passage).agg(F.count("*").alias("n"), F.min(F.struct("writer", "quotes")).alias("first"))
    asked = written(prints_of.where("level > 0").select(*key, "level", "low", "high").distinct().join(known, passage)
                    .where("first.writer < _lm_seq"), "quoted")
    found = [
        asked.where(F.col("n") <= many).join(writers, passage).where("writer < _lm_seq")
        .select(*key, "level", "writer", "quotes")]
    common = asked.where(F.col("n") > many)
    if common.limit(1).count():
        hot = writers.join(common.select(*passage).distinct(), passage).where("quotes").select(*passage, "writer")
        other = [F.col("low").alias("low2"), F.col("high").alias("high2")]
        below = prints_of.where("level > 0").select(*key, (F.col("level") - 1).alias("level"), *other).distinct()
        replied = below.where("level = 0").select("_lm_scope", F.col("_lm_seq").alias("writer"), "low2", "high2")
        asking = common.select(*key, "level", "low", "high")
        last = _last_before(hot, asking, passage).unionByName(_last_before(
            hot.join(replied, ["_lm_scope", "writer"]), asking.join(below, [*key, "level"]), [*passage, "low2", "high2"],
        ).drop("low2", "high2"))
        found += [
            common.select(*key, "level", F.col("first.writer").alias("writer"), F.col("first.quotes").alias("quotes")),
            last.select(*key, "level", "writer", F.lit(True).alias("quotes"))]
    candidates = found[0]
    for frame in found[1:]:
        candidates = candidates.unionByName(frame)
    message = Window.partitionBy(*key)
    candidates = written(
        candidates.groupBy(*key, "level", "writer").agg(F.max("quotes").alias("quotes"))
        .withColumn("near", F.min("level").over(message)).where("level = near")
        .withColumn("n", F.count("*").over(message)).drop("near"), "candidates")
    several = candidates.where("n > 1").drop("n")
    quoted = prints_of.where("level > 0").groupBy(*key, F.col("level").alias("at"), "low", "high").agg(F.sum("weight").alias("weight"))
    held = prints_of.select("_lm_scope", F.col("_lm_seq").alias("writer"), F.col("level").alias("d"), "low", "high").distinct()
    best = (
        several.join(quoted, key).where("at >= level").withColumn("d", F.col("at") - F.col("level"))
        .join(held, ["_lm_scope", "writer", "d", "low", "high"]).groupBy(*key, "writer", "quotes").agg(
            F.sum(F.when(F.col("d") == 0, F.col("weight")).otherwise(0)).alias("weight"),
            F.sum(F.when(F.col("d") > 0, F.col("weight")).otherwise(0)).alias("deeper"))
        .withColumn("place", F.rank().over(message.orderBy(F.desc("weight"), F.desc("deeper")))).where("place = 1"))
    return candidates.where("n = 1").select(*key, F.col("writer").alias("up")).unionByName(
        best.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("quotes"), F.col("writer"))), F.min("writer")).alias("up")))


def link(messages: DataFrame, scope_col: str, seq_col: str, text_col: str, many: int = MANY) -> DataFrame:
    """``scope_col``, ``seq_col``, ``own``, ``parent``, ``root``, ``depth`` for each message.

    ``scope_col`` is the archive in which quotes are looked up (a list, a folder), ``seq_col``
    a message's place in it; both integers, together the message's key. ``own`` is the text
    without quotes, ``parent`` the place of the message it answers, ``root`` that of the
    conversation's first message, ``depth`` the number of replies up to it: sorted by
    ``depth`` and place, a conversation is in reply order. Messages that quote no earlier one
    are roots, with null parent and depth 0. Of several candidates the one at the lowest
    quote level wins, then by length of what was quoted, then by length of the deeper quotes
    that the candidate has one level up, then the latest that quotes something itself. If
    none does, they are copies, and the first is the original.

    A null text is an empty one. Messages with a null scope or place cannot be quoted and
    quote nothing: they are roots by themselves. Rows with equal keys are one message for
    linking; each is returned. An empty table gives an empty result.

    Texts are read once and not exchanged with the hashes. Every earlier writer of a passage is
    a candidate. Of a passage with more than ``many`` writers in its scope, which would meet in
    pairs, only these are brought by that passage: the first, the last before the reply that
    quotes something, and the last before it that quotes what the reply has one level deeper,
    for each print there. Their scores, and those of candidates that rarer passages bring,
    count all prints. Conversations are found by doubling, in as many rounds as the longest
    chain has binary digits; a round takes only the messages whose root is not known yet.
    """
    parsed = written(messages.select(
        F.col(scope_col).cast("long").alias("_lm_scope"), F.col(seq_col).cast("long").alias("_lm_seq"),
        text_of(text_col).alias("t")).mapInArrow(_parse_all, _PARSED), "parsed")
    key = ["_lm_scope", "_lm_seq"]
    prints_of = parsed.where("_lm_scope IS NOT NULL AND _lm_seq IS NOT NULL").select(
        *key, F.exists("prints", lambda p: p["level"] > 0).alias("quotes"), F.explode("prints").alias("p")).select(
        *key, "quotes", "p.*")
    replies = written(_parents(prints_of, many).withColumn("depth", F.lit(1).cast("long")), "replies")
    # ``up`` is 1, 2, 4, ... replies above; a message whose ``up`` is a root goes on no more.
    going, ended = replies.withColumn("ended", F.lit(False)), []
    while True:
        known = going
        for frame in ended:
            known = known.unionByName(frame)
        higher = known.select(
            "_lm_scope", F.col("_lm_seq").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"),
            F.col("ended").alias("ended2"))
        step = written(going.join(higher, ["_lm_scope", "up"], "left").select(
            *key, F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"),
            F.coalesce("ended2", F.lit(True)).alias("ended")), "ancestors")
        ended.append(step.where("ended"))
        going = step.where("NOT ended")
        if not going.limit(1).count():
            break
    above = ended[0]
    for frame in ended[1:]:
        above = above.unionByName(frame)
    tree = replies.select(*key, F.col("up").alias("parent")).join(above.select(*key, F.col("up").alias("root"), "depth"), key)
    return parsed.select(*key, "own").join(tree, key, "left").select(
        F.col("_lm_scope").alias(scope_col), F.col("_lm_seq").alias(seq_col), "own", "parent",
        F.coalesce("root", "_lm_seq").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))


def mails(turns: DataFrame) -> DataFrame:
    """Conversations as mails: each turn quotes the one before, and that one's quote, above its text."""
    def quoted(column: str, mark: str):
        return F.concat(F.lit(mark), F.regexp_replace(column, "\n", f"\n{mark}"), F.lit("\n"))

    keys = ["conv_id", "turn"]
    plain = turns.select(*keys, "role", text_of("text").alias("text"))
    before = plain.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("role1"), F.col("text").alias("text1"))
    twice = plain.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("text").alias("text2"))
    body = F.concat(
        F.coalesce(F.concat(F.col("role1"), F.lit(" wrote:\n")), F.lit("")),
        F.coalesce(quoted("text2", "> > "), F.lit("")), F.coalesce(quoted("text1", "> "), F.lit("")),
        F.when(F.col("text1").isNotNull(), "\n").otherwise(""), F.col("text"))
    return plain.join(before, keys, "left").join(twice, keys, "left").select(*keys, body.alias("mail"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return link(mails(turns), "conv_id", "turn", "mail").select(
        "conv_id", "turn", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"),
        F.col("depth").alias("position"), F.sha2("own", 256).alias("own_sha256"))


#: The mails are made so that each turn answers the one before it.
SQL = r"""
WITH steps AS (
  SELECT conv_id, turn, text,
         lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) = turn - 1 AS answers
  FROM conversations),
runs AS (
  SELECT *, max(CASE WHEN answers THEN NULL ELSE turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS root
  FROM steps)
SELECT conv_id, turn::BIGINT AS turn, CASE WHEN answers THEN turn - 1 END::BIGINT AS parent_turn,
       root::BIGINT AS root_turn, (turn - root)::BIGINT AS position,
       sha256(trim(coalesce(text, ''), chr(10))) AS own_sha256
FROM runs
"""
