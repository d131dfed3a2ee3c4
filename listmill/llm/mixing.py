"""Mixing sources to target weights by weighted fair queueing (operator 10).

The documents of a source stand in a shuffled queue, repeated up to a limit. A document's
virtual finish time is the words its source has sent up to its end, divided by the source's
weight. Taken in order of finish time until the budget is used up, the sources get shares
by their weights, and what a source cannot fill goes to the others by weight.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listmill.llm.common import documents, n_words, text_of, written

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Parts of a source's shuffled queue; each is put in order by itself.
CELLS = 1024
#: Cells of the histogram that finds the last finish time taken.
_BINS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``_lm_source``, ``source_size`` in; adds ``_lm_weight`` and ``target``.

    Targets share all sizes by weight; none is above ``max_copies`` times its source, and the
    excess is shared again. Sources ordered by the level at which they are full: the first
    that is not full settles the level for all that follow. One row per source.
    """
    named = Window.orderBy(F.col("_lm_source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = sizes.withColumn("_lm_weight", F.get(cycle, (F.row_number().over(named) - 1) % len(weights)))
    cap = F.col("source_size") * max_copies
    rows = rows.withColumns({"_lm_cap": cap, "_lm_full": cap / F.col("_lm_weight")})
    order = Window.orderBy("_lm_full", F.col("_lm_source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_lm_level", (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("_lm_cap").over(before), F.lit(0))
    ) / F.sum("_lm_weight").over(after))
    level = F.max(F.when(F.col("_lm_level") < F.col("_lm_full"), F.col("_lm_level"))).over(everything)
    rows = rows.withColumn("_lm_level", level)
    target = F.when(F.col("_lm_level").isNull(), F.col("_lm_cap").cast("double")).otherwise(
        F.least(F.col("_lm_cap").cast("double"), F.col("_lm_weight") * F.col("_lm_level")))
    return rows.select("_lm_source", "source_size", "_lm_weight", target.alias("target"))


def _finish_times(rows: DataFrame, weights, max_copies: int) -> DataFrame:
    """Adds ``source_size``, ``target``, ``_lm_finish`` and ``_lm_round`` to measured rows.

    ``_lm_finish`` is the finish time of a document's first copy; each further one follows
    ``_lm_round`` later. The running sum of a source starts anew in each cell of the shuffled
    queue, from the sums of the cells before, so a source with a third of all rows is no
    single task.
    """
    sums = written(
        rows.groupBy("_lm_source", "_lm_cell").agg(F.sum("size").alias("_lm_sum")), "source-sums")
    targets = source_targets(
        sums.groupBy("_lm_source").agg(F.sum("_lm_sum").alias("source_size")), weights, max_copies)
    before = Window.partitionBy("_lm_source").orderBy("_lm_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("_lm_source").alias("_lm_s"), F.col("_lm_cell").alias("_lm_c"),
        F.coalesce(F.sum("_lm_sum").over(before), F.lit(0)).alias("_lm_start"))
    facts = written(
        starts.join(targets, F.col("_lm_s").eqNullSafe(F.col("_lm_source"))).drop("_lm_source"), "source-facts")
    inside = Window.partitionBy("_lm_source", "_lm_cell").orderBy("_lm_shuffle", "_lm_id").rowsBetween(
        Window.unboundedPreceding, 0)
    joined = rows.withColumn("_lm_run", F.sum("size").over(inside)).join(
        facts, F.col("_lm_source").eqNullSafe(F.col("_lm_s")) & (F.col("_lm_cell") == F.col("_lm_c")))
    return joined.withColumns({
        "_lm_finish": (F.col("_lm_start") + F.col("_lm_run")) / F.col("_lm_weight"),
        "_lm_round": F.col("source_size") / F.col("_lm_weight"),
    }).drop("_lm_run", "_lm_start", "_lm_s", "_lm_c", "_lm_weight")


def _copies_by(time: float, max_copies: int):
    """How many copies have finished by a time."""
    return sum(
        (F.col("_lm_finish") + i * F.col("_lm_round") <= F.lit(time)).cast("int") for i in range(max_copies))


def last_time(timed: DataFrame, max_copies: int) -> float:
    """The largest finish time up to which all copies together fit the budget.

    The budget is the sum of all sizes. A histogram over finish times finds the cell in which
    it runs out; that cell is divided again until it holds one time. Each pass is one
    aggregation to at most ``_BINS`` rows, whatever the size of the table.
    """
    copies = timed.where("size > 0").select(
        "size", F.explode(F.array(*[F.col("_lm_finish") + i * F.col("_lm_round") for i in range(max_copies)])).alias("t"))
    low, high, budget = timed.agg(
        F.lit(0.0), F.max(F.col("_lm_finish") + (max_copies - 1) * F.col("_lm_round")),
        F.coalesce(F.sum("size"), F.lit(0))).first()
    if not budget:
        return -1.0
    taken = 0
    while True:  # in (low, high] the budget runs out; up to low it does not
        width = (high - low) / _BINS
        cell = F.least(F.floor((F.col("t") - low) / width), F.lit(_BINS - 1))
        found = (
            copies.where((F.col("t") > low) & (F.col("t") <= high)).groupBy(cell.alias("cell"))
            .agg(F.sum("size").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
            .orderBy("cell").collect())
        for row in found:
            if taken + row["n"] > budget:
                if row["first"] == row["last"]:
                    return low
                break
            taken, low = taken + row["n"], row["last"]
        else:
            return low
        # The cell's first time may fit by itself; start just below it.
        low, high = max(low, float(np.nextafter(row["first"], 0))), row["last"]


def mix(
    docs: DataFrame, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", seed: int = 23, weights=WEIGHTS, max_copies: int = MAX_COPIES,
) -> DataFrame:
    """Every row with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``columns`` of the input are returned (all if None); of the five names, the input's are
    replaced. Sizes are words; a null text has none. Sources take the weights in code point
    order, a null source last. ``copies`` (0 to ``max_copies``) is how often the mix takes
    the document; ``taken`` is that times its size. Documents without words are taken like
    their place in the queue says and count nothing; if no document has words, none is taken.
    Copies that finish at the same time are taken all or not at all, so rows that tie are
    treated alike. Reruns agree: the queue's order comes from ids and texts.

    The rows with their sizes are written once; all later passes read narrow columns of that
    table, except the last, which brings all columns to their source's cell.
    """
    columns = [c for c in (columns or docs.columns) if c not in ("size", "source_size", "target", "copies", "taken")]
    text = text_of(text_col)
    shuffle = F.xxhash64(F.lit(seed), F.col(id_col), text)
    rows = written(docs.select(
        *columns, n_words(text).alias("size"), F.col(source_col).alias("_lm_source"), F.col(id_col).alias("_lm_id"),
        shuffle.alias("_lm_shuffle"), F.pmod(shuffle, F.lit(CELLS)).alias("_lm_cell")), "measured")
    timed = _finish_times(rows, weights, max_copies)
    time = last_time(written(timed.select("size", "_lm_finish", "_lm_round"), "finish-times"), max_copies)
    counted = timed.withColumn("copies", _copies_by(time, max_copies))
    return counted.select(
        *columns, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_lm_finish", "_lm_round")


def in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: a row for each copy, range-sorted by finish time."""
    copies = mixed.where("copies > 0").withColumn("_lm_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copies.orderBy(F.col("_lm_finish") + F.col("_lm_copy") * F.col("_lm_round")).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), columns=["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")
