"""Removal of lines that several documents share (operator 5).

Lines are exploded, normalised and hashed; the documents of each hash are aggregated; lines
of shared hashes go, except in the first document; the rest is put together by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm.common import (
    BLANK_TEXT, ascii_lower, doc_key, documents, hash_pair, text_of, written)

MIN_LENGTH = 10


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
) -> DataFrame:
    """The rows with ``n_lines``, ``n_dropped`` and ``kept_text`` (replacing columns of these names).

    A line's key is the line without blanks at its ends and with A-Z in lower case. Keys of
    at least ``min_length`` code points in two documents or more lose all their lines except
    in the document with the smallest id. A null text is one empty line. Documents with a
    null id count as one document that comes after all others. Rows with the same id are one
    document; each is returned. An empty table gives an empty result.

    What is shuffled per line is two hashes, an id and a position. A key's documents are
    reduced to the smallest and largest id before the exchange, so a line that a third of
    all documents hold is one row per task. The second join has a table of shared keys on
    the other side, written first so that its size is known; beyond the broadcast threshold
    adaptive execution splits a frequent key.
    """
    id_key, text_key = doc_key(id_col, text_col)
    text = text_of(text_col)
    key = F.btrim(ascii_lower(F.col("_lm_line")), F.lit(BLANK_TEXT))
    lines = (
        docs.select(id_key, text_key, F.posexplode_outer(F.split(text, "\n")).alias("_lm_at", "_lm_line"))
        .select("_lm_id", "_lm_text", "_lm_at", key.alias("_lm_line"))
        .where(F.char_length("_lm_line") >= min_length))
    low, high = hash_pair(F.col("_lm_line"))
    lines = written(
        lines.select("_lm_id", "_lm_text", "_lm_at", low.alias("_lm_low"), high.alias("_lm_high")), "lines")
    shared = written(
        lines.groupBy("_lm_low", "_lm_high")
        .agg(F.min("_lm_id").alias("_lm_first"), F.max("_lm_id").alias("_lm_last"))
        .where("_lm_first < _lm_last").drop("_lm_last"), "shared-lines")
    dropped = (
        lines.join(shared, ["_lm_low", "_lm_high"]).where("_lm_id > _lm_first")
        .groupBy("_lm_id", "_lm_text").agg(F.collect_set("_lm_at").alias("_lm_drop")))
    keyed = docs.withColumns({"_lm_id": id_key, "_lm_text": text_key})
    joined = keyed.join(dropped, ["_lm_id", "_lm_text"], "left").withColumns({
        "_lm_lines": F.split(text, "\n"),
        "_lm_drop": F.coalesce("_lm_drop", F.array().cast("array<int>"))})
    joined = joined.withColumns({
        "n_lines": F.size("_lm_lines").cast("long"), "n_dropped": F.size("_lm_drop").cast("long"),
        "_lm_keep": F.array_except(F.sequence(F.lit(0), F.size("_lm_lines") - 1), "_lm_drop")})
    rest = F.array_join(F.transform("_lm_keep", lambda i: F.get("_lm_lines", i)), "\n")
    return joined.withColumns({
        "kept_text": F.when(F.size("_lm_drop") == 0, text).otherwise(rest),
    }).drop("_lm_id", "_lm_text", "_lm_drop", "_lm_lines", "_lm_keep")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_shared_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i
        FROM documents)),
keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT doc_id, i, line, coalesce(doc_id > first, false) AS gone
  FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
