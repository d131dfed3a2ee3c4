"""Line-first cleaning (operator 6).

Each line is judged by itself: does it read like sentences, like navigation, like
boilerplate? Failing lines are removed; a document that loses too much is rejected. All of
it is one scan of built-in functions without an exchange: a row holds all that its verdict
needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm.common import BLANKS, WORD, documents, text_of, words

# Fixed values.
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A word that ends a sentence or clause.
SENTENCE_END = rf"[.!?:;…。！？][\"'”’»)\]]*(?:[{BLANKS}]|$)"
#: Marks that prose seldom has; a line with more of them than this share of its words fails.
NOISE = r"[#*$%&|<>{}=~^!?\\]"
NOISE_SHARE = 0.5
#: Menus: separators between entries, or a short line of typical entries.
MENU = r"(?:[|»›·•].*){2}|^[>»›]"
MENU_WORDS = (
    rf"(?i)^[{BLANKS}]*(?:home|menu|log ?in|sign ?(?:in|up)|search|next|previous|back to top|"
    rf"read more|share|contact us|about us|subscribe|skip to content)[{BLANKS}.!:]*$"
)
BOILERPLATE = (
    r"(?i)lorem ipsum|all rights reserved|privacy policy|terms of (?:use|service)|"
    r"uses? cookies|enable javascript|click here"
)
#: A document that loses more than this share of its text is rejected.
MAX_LOSS = 0.5


def line_fault(line: Column) -> Column:
    """Which rule a line fails: ``punctuation``, ``navigation``, ``boilerplate``, or null."""
    noisy = F.regexp_count(line, F.lit(NOISE)) > NOISE_SHARE * F.regexp_count(line, F.lit(WORD))
    return (
        F.when(line.rlike(MENU) | line.rlike(MENU_WORDS), "navigation")
        .when(~line.rlike(SENTENCE_END) | noisy, "punctuation")
        .when(line.rlike(BOILERPLATE), "boilerplate")
    )


def _ink(text: Column) -> Column:
    """Code points that are in words."""
    return F.char_length(F.regexp_replace(text, f"[{BLANKS}]+", "")).cast("long")


def _repeat_words(ordered: Column) -> Column:
    """Words inside three-word windows that occur again, from the windows in hash order.

    Windows are compared by 64-bit hashes within one text.
    """
    following = F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(0)))
    twins = F.array_compact(F.zip_with(
        ordered, following, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))
    return F.sort_array(F.array_distinct(F.flatten(twins)))


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with statistics, the cleaned text and the verdict.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``n_lines_removed``, ``cleaned`` (the text without failing lines),
    ``loss`` (share of word characters lost) and ``kept``; input columns of these names are
    replaced. A null text is an empty one: no words, failed, not kept. Rows are judged one
    by one, so repeated rows get equal verdicts; an empty table gives an empty result. Lines
    without a word are neither judged nor removed. To filter on the verdict, take
    ``kept_rows`` or write the result first.
    """
    text = F.col("_lm_text")
    line_list = F.split(text, "\n")
    # Each level is a projection of its own, so nothing costly is computed twice.
    step = docs.withColumns({"_lm_text": text_of(text_col)})
    step = step.withColumns({
        "_lm_words": words(text),
        "_lm_lines": F.filter(line_list, lambda x: x.rlike(WORD)),
        "_lm_rest": F.filter(line_list, lambda x: ~x.rlike(WORD) | line_fault(x).isNull()),
    })
    step = step.withColumns({
        "n_words": F.size("_lm_words").cast("long"),
        "_lm_windows": F.expr(
            "CASE WHEN size(_lm_words) > 3 THEN sort_array(transform("
            "sequence(0, size(_lm_words) - 3), i -> struct("
            "xxhash64(get(_lm_words, i), get(_lm_words, i + 1), get(_lm_words, i + 2)) AS h, "
            "i AS i))) ELSE array() END"),
        "word_chars": _ink(text),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size("_lm_lines") - F.size(F.array_distinct("_lm_lines"))).cast("long"),
        "_lm_cleaned": F.array_join("_lm_rest", "\n"),
        "n_lines_removed": (F.size(line_list) - F.size("_lm_rest")).cast("long"),
    }).drop("_lm_words", "_lm_lines", "_lm_rest")
    step = step.withColumns({
        "_lm_at": _repeat_words(F.col("_lm_windows")), "_lm_left": _ink(F.col("_lm_cleaned"))}).drop("_lm_windows")
    covered = F.zip_with(
        "_lm_at", F.slice("_lm_at", F.lit(2), F.size("_lm_at") + 1),
        lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3)))
    step = step.withColumns({
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda s, x: s + x).cast("long"),
        "loss": F.when(F.col("word_chars") > 0, 1 - F.col("_lm_left") / F.col("word_chars"))
        .otherwise(F.lit(0.0)),
    })
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    step = step.withColumns({"base_failed": failed, "cleaned": F.col("_lm_cleaned")})
    step = step.withColumns({"kept": ~F.col("base_failed") & (F.col("loss") <= MAX_LOSS)})
    return step.drop("_lm_text", "_lm_cleaned", "_lm_left", "_lm_at")


def kept_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of the documents that are kept, as they are."""
    columns = {f"_lm_c{i}": F.col(c) for i, c in enumerate(docs.columns)}
    judged = clean(docs.withColumns(columns), text_col).select(*columns, "kept", F.monotonically_increasing_id().alias("_lm_row"))
    # The row number keeps the optimizer from moving the filter below the projections of
    # the verdict, where it would compute all of them again inside each other.
    return judged.where("kept AND _lm_row >= 0").select(*[F.col(k).alias(c) for k, c in zip(columns, docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_lines_removed")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LINE_FAILS = f"""
  regexp_matches(line, {_quoted(MENU)}) OR regexp_matches(line, {_quoted(MENU_WORDS)})
  OR NOT regexp_matches(line, {_quoted(SENTENCE_END)})
  OR len(regexp_extract_all(line, {_quoted(NOISE)})) > {NOISE_SHARE} * len(regexp_extract_all(line, {_quoted(WORD)}))
  OR regexp_matches(line, {_quoted(BOILERPLATE)})"""

SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_quoted(WORD)}) AS w FROM documents),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
  FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM texts))),
repeats AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM windows, range(0, 3) AS t(d) WHERE n > 1 GROUP BY 1),
lines AS (
  SELECT doc_id, line, regexp_matches(line, {_quoted(WORD)}) AS worded,
         length(regexp_replace(line, '[{BLANKS}]+', '', 'g')) AS ink
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)),
by_line AS (
  SELECT doc_id, count(*) FILTER (WHERE worded) - count(DISTINCT line) FILTER (WHERE worded) AS n_dup_lines,
         sum(ink) AS word_chars, coalesce(sum(ink) FILTER (WHERE worded AND ({_LINE_FAILS})), 0) AS lost,
         count(*) FILTER (WHERE worded AND ({_LINE_FAILS})) AS gone
  FROM lines GROUP BY 1),
base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
         len(regexp_extract_all(text, {_quoted(SYMBOLS)}))::BIGINT AS n_symbols, n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, lost, gone
  FROM texts JOIN by_line USING (doc_id) LEFT JOIN repeats USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
         AND (word_chars = 0 OR lost <= {MAX_LOSS} * word_chars) AS kept,
       gone::BIGINT AS n_lines_removed
FROM base
"""
