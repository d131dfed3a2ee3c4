"""Benchmark decontamination by spaced seeds (operator 7).

Fixed masks lie over the token sequence; each hashes some positions and ignores the rest.
Equal hashes of a benchmark item and a document are a hit, and around it the two are laid
side by side and their equal tokens counted. The masks are chosen so that none of the
windows looked for can escape: every placing of the allowed substitutions leaves one mask
untouched somewhere in the window.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm.common import doc_key, documents, text_of, written

#: Token positions that each mask hashes.
MASKS = ((0, 1, 2, 3, 4), (0, 3, 6, 7, 8))
#: Tokens of a window; an item with fewer is a window as a whole.
WINDOW = 16
#: Window length and substitutions allowed from there on; shorter items never match. For
#: each length, all placings of so many substitutions were tried against the masks.
ALLOWED = ((16, 3), (13, 2), (9, 1), (5, 0))
#: Tokens before a hit that a window with the shortest mask reaches.
BEFORE = WINDOW - min(mask[-1] + 1 for mask in MASKS)
#: Seeds of a benchmark that are sent to all executors at once (16 bytes and an id each).
BROADCAST_SEEDS = 2_000_000
#: A larger benchmark is sent in so many parts at most, each a pass over the documents; a
#: still larger one is joined by exchanging both sides.
PASSES = 8
DOC_KEYS = ["_lm_id", "_lm_text", "_lm_null"]


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def allowed(length: Column) -> Column:
    """Substitutions allowed in a window; null where there is no match at all."""
    value = F.lit(None).cast("int")
    for least, n in reversed(ALLOWED):
        value = F.when(length >= least, n).otherwise(value)
    return value


def _seeds(rows: DataFrame, keys: list[str], words: str, keep: list[str]) -> DataFrame:
    """A row for each place and mask that fits there: ``keys``, ``keep``, place, mask, hash.

    Rows are exploded to places and the hashes computed in generated code; ``keep`` costs
    nothing until a row has passed the join.
    """
    places = rows.select(*keys, *keep, F.explode_outer(
        F.sequence(F.lit(0), F.greatest(F.size(words), F.lit(1)) - 1)).alias("_lm_at"))
    hashes = [
        F.when(F.col("_lm_at") + mask[-1] < F.size(words), F.xxhash64(
            F.lit(m), *[F.get(words, F.col("_lm_at") + i) for i in mask]))
        for m, mask in enumerate(MASKS)]
    columns = [c for c in dict.fromkeys([*keys, *keep])]
    return places.select(*columns, "_lm_at", F.posexplode_outer(F.array(*hashes)).alias("_lm_mask", "_lm_seed")).where(
        "_lm_seed IS NOT NULL")


def _settled(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a further column that is computed once, in a generated method of its own.

    A projected column would be copied into every filter above it, and into the method of the
    step below it, which beyond 8,000 bytes is never compiled.
    """
    return rows.select("*", F.explode_outer(F.array(value)).alias(name))


def _side_by_side(hits: DataFrame) -> DataFrame:
    """Adds ``_lm_window`` and ``_lm_equal``: the best window around the hit.

    In: ``_lm_words``, ``_lm_at`` of the document, ``_lm_item_words``, ``_lm_item_at``, ``_lm_mask``.
    The tokens that windows around a hit reach are compared to bits, and a window's are counted.
    A window that sticks out has no bits there, so it counts no more than the one that ends
    where item or document does. No lambda is used: generated code would end below it and hold
    every hit of a document at once, each with a copy of all its tokens.
    """
    item, doc = F.col("_lm_item_words"), F.col("_lm_words")
    span = F.get(F.array(*[F.lit(mask[-1] + 1) for mask in MASKS]), F.col("_lm_mask"))
    window, shift = F.least(F.size(item), F.lit(WINDOW)), F.col("_lm_at") - F.col("_lm_item_at")
    hits = hits.where(
        F.greatest(F.lit(0), F.col("_lm_item_at") + span - window, -shift)
        <= F.least(F.col("_lm_item_at"), F.size(item) - window, F.size(doc) - window - shift))
    bits = [
        F.when(F.get(item, F.col("_lm_item_at") + at) == F.get(doc, F.col("_lm_at") + at), F.lit(1 << n)).otherwise(0)
        for n, at in enumerate(range(-BEFORE, WINDOW))]
    half = len(bits) // 2
    hits = _settled(hits, "_lm_first", functools.reduce(Column.bitwiseOR, bits[:half]))
    hits = _settled(hits, "_lm_same", functools.reduce(Column.bitwiseOR, bits[half:], F.col("_lm_first")))
    windows = [
        F.bit_count(F.shiftright("_lm_same", start).bitwiseAND(F.lit((1 << WINDOW) - 1))) for start in range(BEFORE + 1)]
    equal = F.when(F.size(item) < WINDOW, F.bit_count("_lm_same")).otherwise(F.greatest(*windows))
    return _settled(hits.withColumn("_lm_window", window), "_lm_equal", equal)


def _aligned(rows: DataFrame) -> DataFrame:
    """Adds ``_lm_window`` and ``_lm_equal``: the best window of an item and the tokens beside it.

    In: ``_lm_item_words``; ``_lm_beside``, the document's tokens from the item's ``_lm_from`` on.
    """
    rows = rows.withColumn("_lm_window", F.least(F.size("_lm_item_words"), F.lit(WINDOW))).where(
        F.size("_lm_beside") >= F.col("_lm_window"))
    length = F.size("_lm_beside")
    rows = _settled(rows, "_lm_same", F.zip_with(
        F.slice("_lm_item_words", F.col("_lm_from") + 1, length), "_lm_beside", lambda a, b: (a == b).cast("int")))
    sums = F.transform(
        F.sequence(F.lit(1), length - F.col("_lm_window") + 1),
        lambda k: F.aggregate(F.slice("_lm_same", k, F.col("_lm_window")), F.lit(0), lambda s, x: s + x))
    return _settled(rows, "_lm_equal", F.array_max(sums))


def _best(compared: DataFrame) -> DataFrame:
    """The most equal tokens of each document, item id and window, where they are enough.

    Items that share an id, or have none, are held against what their own window allows.
    """
    return compared.where(F.col("_lm_equal") >= F.col("_lm_window") - allowed(F.col("_lm_window"))).groupBy(
        *DOC_KEYS, "_lm_item", "_lm_window").agg(F.max("_lm_equal").alias("_lm_equal"))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """``_lm_id``, ``_lm_text`` (a row's key), ``id_col``, ``item_col``, ``window``, ``equal``.

    One row for each document and item that agree in a window of 16 tokens (or the whole of
    a shorter item) but for the allowed substitutions; ``equal`` is the most tokens that are
    equal in a window. Different texts under one item id, or under none, count each by its
    own length: there is a row for each ``window`` that matches. Items of fewer than 5 tokens, null and empty texts match nothing. A
    null id is kept. Rows with equal id and text are one document, items with equal id and
    text one item. Empty tables give an empty result.

    Documents are not exchanged: every place of every text is looked up where it is, among
    at most ``broadcast_seeds`` seeds, and compared in the same generated code. A benchmark
    with more seeds (counted first) is looked up in parts, one pass over the documents each;
    beyond ``PASSES`` parts it is joined on the hashes, which carry keys and places only, and
    each way to lay an item on a document is compared once.
    """
    keys = list(doc_key(id_col, text_col))
    items = written(
        benchmark.select(F.col(item_col).alias("_lm_item"), tokens(text_of(item_text_col)).alias("_lm_item_words"))
        .distinct().where(F.size("_lm_item_words") >= ALLOWED[-1][0])
        .withColumn("_lm_item_key", F.xxhash64("_lm_item", "_lm_item_words")), "benchmark")
    seeds = written(_seeds(items, ["_lm_item_key"], "_lm_item_words", ["_lm_item_words"]).select(
        "_lm_item_key", F.size("_lm_item_words").alias("_lm_item_size"), F.col("_lm_at").alias("_lm_item_at"),
        "_lm_mask", "_lm_seed"), "seeds")
    texts = docs.select(*keys, F.col(id_col).isNull().alias("_lm_null"), tokens(text_of(text_col)).alias("_lm_words"))
    places = _seeds(texts, DOC_KEYS, "_lm_words", ["_lm_words"])

    def looked_up(part: Column) -> DataFrame:
        hits = places.join(F.broadcast(seeds.where(part).drop("_lm_item_size")), ["_lm_seed", "_lm_mask"])
        return _best(_side_by_side(hits.join(F.broadcast(items.where(part)), "_lm_item_key")))

    n_seeds = seeds.count()
    if n_seeds <= broadcast_seeds:
        best = looked_up(F.lit(True))
    elif n_seeds <= broadcast_seeds * PASSES:
        parts = -(-n_seeds // broadcast_seeds)
        # One after the other, so that no two parts are in memory.
        best = [written(looked_up(F.pmod("_lm_item_key", F.lit(parts)) == k), "overlaps") for k in range(parts)]
        best = _best(functools.reduce(DataFrame.unionAll, best))
    else:
        shift = F.col("_lm_at") - F.col("_lm_item_at")
        found = places.select(*DOC_KEYS, "_lm_at", "_lm_mask", "_lm_seed").join(seeds, ["_lm_seed", "_lm_mask"])
        found = written(found.select(*DOC_KEYS, "_lm_item_key", "_lm_item_size", shift.alias("_lm_shift")).distinct(), "hits")
        start = F.greatest(-F.col("_lm_shift"), F.lit(0))
        beside = found.join(texts, DOC_KEYS).select(
            *DOC_KEYS, "_lm_item_key", start.alias("_lm_from"),
            F.slice("_lm_words", F.col("_lm_shift") + start + 1, F.col("_lm_item_size") - start).alias("_lm_beside"))
        best = _best(_aligned(beside.join(items, "_lm_item_key")))
    return best.select(
        "_lm_id", "_lm_text", F.when(~F.col("_lm_null"), F.col("_lm_id")).alias(id_col),
        F.col("_lm_item").alias(item_col), F.col("_lm_window").alias("window"), F.col("_lm_equal").alias("equal"))


def remove(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of documents that overlap with no item."""
    found = written(overlaps(docs, benchmark, **names).select("_lm_id", "_lm_text").distinct(), "contaminated")
    id_key, text_key = doc_key(names.get("id_col", "doc_id"), names.get("text_col", "text"))
    return docs.withColumns({"_lm_id": id_key, "_lm_text": text_key}).join(
        found, ["_lm_id", "_lm_text"], "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return overlaps(documents(spark, sf_dir), benchmark).select("doc_id", "item_id", "window", "equal")


#: A window with so few substitutions has four equal tokens in a row somewhere; these find
#: the alignments, whose windows are then counted.
SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS v FROM benchmark),
doc_runs AS (
  SELECT doc_id, i, array_to_string(w[i:i + 3], ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1))) AS i FROM docs)),
item_runs AS (
  SELECT item_id, j, array_to_string(v[j:j + 3], ' ') AS run
  FROM (SELECT item_id, v, unnest(range(1, greatest(len(v) - 2, 1))) AS j FROM items)),
alignments AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM doc_runs JOIN item_runs USING (run)),
windows AS (
  SELECT doc_id, item_id, shift, w, v, least(len(v), 16)::INT AS size,
         unnest(range(greatest(1, 1 - shift), least(len(v), len(w) - shift) - least(len(v), 16) + 2)) AS k
  FROM alignments JOIN docs USING (doc_id) JOIN items USING (item_id) WHERE len(v) >= 5),
counted AS (
  SELECT doc_id, item_id, size,
         len(list_filter(range(k, k + size), lambda p: v[p] = w[p + shift]))::INT AS equal FROM windows)
SELECT doc_id, item_id, size AS window, max(equal) AS equal FROM counted
WHERE equal >= size - CASE WHEN size >= 16 THEN 3 WHEN size >= 13 THEN 2 WHEN size >= 9 THEN 1 ELSE 0 END
GROUP BY 1, 2, 3
"""
