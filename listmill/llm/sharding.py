"""Uniform shuffle into shards of exact sizes (operator 2).

A communication matrix says how many rows each input partition sends to each shard. It is
drawn from the multivariate hypergeometric law, so the whole is as random as one shuffle of
all rows, although each partition is permuted by itself, cut by its row of the matrix, sent,
and permuted again in its shard. Shard sizes are exact: they differ by one at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listmill.llm.common import documents, small_table, text_of, written

SHARDS = 8
#: Rows of a shard that one window group puts in order, on average.
BLOCK_ROWS = 10_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` rows, taken without replacement, are among the ``good`` ones.

    By inversion, over all values within 12 standard deviations of the mode: the rest has
    less weight than a double can hold. Unlike numpy's sampler it has no limit on the sizes.
    """
    least, most = max(0, draws - bad), min(draws, good)
    if least == most:
        return least
    total = good + bad
    mode = (draws + 1) * (good + 1) // (total + 2)
    share = good / total
    spread = int(12 * (draws * share * (1 - share)) ** 0.5) + 40
    low, high = max(least, mode - spread), min(most, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows that each partition sends to each shard; margins are the given sizes."""
    rng = np.random.default_rng(seed)
    room, matrix = list(shard_sizes), []
    for size in sizes:
        left, free, row = size, sum(room), []
        for capacity in room:
            n = hypergeometric(rng, capacity, free - capacity, left)
            row.append(n)
            left, free = left - n, free - capacity
        room = [a - b for a, b in zip(room, row)]
        matrix.append(row)
    return matrix


def shuffle_to_shards(
    docs: DataFrame, n_shards: int = SHARDS, seed: int = 11, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The rows with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0 in a shard).

    Input columns of these two names are replaced. No value decides where a row goes, only
    its partition and place, so nulls, repeated rows and frequent keys matter nowhere. Fewer
    rows than shards leave some shards empty; an empty table gives an empty result. The same
    seed and the same input files and splits give the same shards.

    Rows with their places are written first: the matrix must hold for the partitions that
    are cut later, also after an executor is lost. The driver gets one count for each input
    partition, and the matrix has a row for each. A shard is ordered in blocks of hash
    ranges of about ``block_rows`` rows, so no task holds a shard.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    local = (
        docs.withColumn("_lm_at", F.monotonically_increasing_id())
        .sortWithinPartitions(F.xxhash64(F.lit(seed), "_lm_at"), "_lm_at")
        .withColumn("_lm_at", F.monotonically_increasing_id()))
    local = written(local, "permuted")
    part, place = F.shiftrightunsigned("_lm_at", 33), F.col("_lm_at").bitwiseAND(2**33 - 1)
    counts = local.groupBy(part.alias("part")).count().orderBy("part").collect()
    total = sum(r["count"] for r in counts)
    shard_sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([r["count"] for r in counts], shard_sizes, seed)
    cuts = small_table(
        spark, [{"_lm_part": c["part"], "_lm_cuts": np.cumsum(row).tolist()} for c, row in zip(counts, matrix)],
        "_lm_part bigint, _lm_cuts array<bigint>")
    blocks = max(1, -(-total // (n_shards * block_rows)))
    sent = (
        local.withColumns({"_lm_part": part, "_lm_place": place}).join(cuts, "_lm_part")
        .withColumns({
            "shard": F.size(F.filter("_lm_cuts", lambda c: c <= F.col("_lm_place"))),
            "_lm_again": F.xxhash64(F.lit(seed + 1), "_lm_at")})
        .withColumn("_lm_block", F.pmod("_lm_again", F.lit(blocks)).cast("long"))
        .drop("_lm_part", "_lm_place", "_lm_cuts"))
    before = Window.partitionBy("shard").orderBy("_lm_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "_lm_block").agg(F.count("*").alias("_lm_n")).select(
        "shard", "_lm_block", F.coalesce(F.sum("_lm_n").over(before), F.lit(0)).alias("_lm_start"))
    inside = Window.partitionBy("shard", "_lm_block").orderBy("_lm_again", "_lm_at")
    return (
        sent.withColumn("_lm_rank", F.row_number().over(inside))
        .join(starts, ["shard", "_lm_block"])
        .select(*docs.columns, "shard", (F.col("_lm_start") + F.col("_lm_rank") - 1).alias("slot")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = text_of("text")
    rows = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shuffle_to_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
