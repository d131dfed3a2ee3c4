"""Secrets in texts (operator 11): base patterns, then a battery of randomness tests.

Base kinds are found by their patterns. The method looks at every other long token of the
alphabets that keys are written in, infers its encoding (hex, letters and digits, base64),
and tests whether it could be drawn uniformly from that alphabet: a chi-squared test of the
symbol counts, a runs test above and below the alphabet's middle, and a test of the lag-one
serial correlation of symbol values. Fisher's method combines the three p-values. Tokens are
then judged per length class (powers of two) with the Benjamini-Hochberg rule at ``Q``: a
rejection says "not random" at a false discovery rate of ``Q`` among rejections, and what no
test rejects is reported as a secret. The rank of each p-value within its class comes from a
global sort, so no class is put into one task.

All of it is Spark SQL functions: regular expressions, ``split`` for positions, higher-order
functions on arrays for the tests, windows and joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listmill.llm.common import doc_key, documents, text_of, written
from listmill.llm.manifest import numbered

# The base kinds and their patterns, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: ``AKIA[A-Z0-9]+`` of 20 characters or more; as failing matches are dropped without a retry,
#: and a failing match is a whole run, this finds the same spans.
ACCESS = r"AKIA[A-Z0-9]{16,}"
#: ``[0-9a-f]+`` of 24 characters or more, likewise.
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex"]
#: The method's kind, listed after the base ones.
RANDOM = "random"

#: Tokens that the method tests, and the least length of the symbols that it tests.
TOKEN = r"[A-Za-z0-9+/=_-]{20,}"
MIN_SYMBOLS = 16
#: False discovery rate of the rejections "not random", per length class.
Q = 0.05
HEX_DIGITS = "0123456789abcdef"
ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _matches(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """Array of (kind, i, before, length, token, value length) for the leftmost matches.

    ``before`` is the length of the text between the previous match and this one, which
    ``split`` gives with the same matcher; the start is the running sum.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    pieces = F.split(text, pattern, -1)
    zipped = F.arrays_zip(found.alias("t"), values.alias("v"), F.slice(pieces, 1, F.size(found)).alias("p"))
    out = F.transform(zipped, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["p"]).cast("long").alias("before"),
        F.char_length(x["t"]).cast("long").alias("length"), x["t"].alias("token"),
        F.char_length(x["v"]).cast("long").alias("value")))
    return F.when(F.size(found) > 0, out)


def found_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per match of every kind and per token: key, kind, start, end, token, passes."""
    id_key, text_key = doc_key(id_col, text_col)
    text = text_of(text_col)
    every = F.flatten(F.array(*[
        F.coalesce(m, F.array().cast(
            "array<struct<kind:string,i:int,before:bigint,length:bigint,token:string,value:bigint>>"))
        for m in (_matches(text, ASSIGN, "assign", 2), _matches(text, ACCESS, "access"),
                  _matches(text, HEX, "hex"), _matches(text, TOKEN, "token"))]))
    rows = docs.select(id_key, text_key, F.inline(every))
    # Equal rows are one document: their matches are one set.
    rows = rows.groupBy("_lm_id", "_lm_text", "kind", "i").agg(
        *[F.first(c).alias(c) for c in ("before", "length", "token", "value")])
    upto = Window.partitionBy("_lm_id", "_lm_text", "kind").orderBy("i").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("before") + F.col("length")).over(upto)
    passes = (F.when(F.col("kind") == "assign", F.col("value") >= 6)
              .when(F.col("kind") == "access", F.col("length") >= 20).otherwise(F.lit(True)))
    return rows.select("_lm_id", "_lm_text", "kind", (end - F.col("length")).alias("start"), end.alias("end"),
                       "token", passes.alias("passes"))


def _q_normal(z: Column) -> Column:
    """Upper tail of the standard normal, from erfc by a Chebyshev fit (relative error < 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196,
              1.00002368, -1.26551223):
        poly = F.lit(c) + t * poly
    erfc = t * F.exp(-x * x + poly)
    return F.when(z >= 0, erfc / 2).otherwise(1 - erfc / 2)


def battery(tokens: DataFrame, token: str = "token", out: str = "_lm_test") -> DataFrame:
    """``tokens`` with ``out``: a struct of encoding, symbols, the three p-values and their
    Fisher combination.

    The symbol values are made a column of their own before the tests look at them, so that
    each test reads them once per token and not once per element.
    """
    t = F.col(token)
    hex_ = t.rlike("^[0-9A-Fa-f]+$")
    alnum = t.rlike("^[0-9A-Za-z]+$")
    alphabet = F.when(hex_, F.lit(HEX_DIGITS)).when(alnum, F.lit(ALNUM)).otherwise(F.lit(BASE64))
    symbols = F.when(hex_, F.lower(t)).when(alnum, t).otherwise(
        F.translate(F.regexp_replace(t, "=", ""), "-_", "+/"))
    staged = tokens.withColumns({
        "_lm_enc": F.when(hex_, "hex").when(alnum, "alnum").otherwise("base64"),
        "_lm_abc": alphabet, "_lm_sym": symbols})
    staged = staged.withColumn("_lm_vals", F.transform(F.split("_lm_sym", "", -1),
                                                       lambda c: F.instr(F.col("_lm_abc"), c) - 1))
    values = F.col("_lm_vals")
    # Symbol counts in one pass: sorted values, and the places where a run of equal ones ends.
    staged = staged.withColumns({
        "_lm_k": F.char_length("_lm_abc").cast("double"), "_lm_n": F.size(values).cast("double"),
        "_lm_sorted": F.array_sort(values)})
    k, n = F.col("_lm_k"), F.col("_lm_n")
    ends = F.filter(F.sequence(F.lit(0), F.size(values) - 1), lambda i: (i == F.size(values) - 1) | (
        F.get(F.col("_lm_sorted"), i) != F.get(F.col("_lm_sorted"), i + 1)))
    staged = staged.withColumn("_lm_ends", ends)
    squares = F.aggregate(F.transform(F.col("_lm_ends"), lambda e, j: F.when(
        j == 0, e + 1).otherwise(e - F.get(F.col("_lm_ends"), j - 1))), F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    chi2 = k / n * squares - n
    z_chi = (chi2 - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    high = F.size(F.filter(values, lambda v: 2 * v >= k)).cast("double")
    low = n - high
    steps = F.sequence(F.lit(1), F.size(values) - 1)
    changes = F.size(F.filter(steps, lambda i: (2 * F.get(values, i) >= k) != (2 * F.get(values, i - 1) >= k)))
    runs = changes + 1
    mean = 2 * high * low / n + 1
    var = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
    p_runs = F.when(var > 0, 2 * _q_normal(F.abs(runs - mean) / F.sqrt(var))).otherwise(
        F.least(F.lit(1.0), 2 * F.pow(F.lit(0.5), n)))
    mid = (k - 1) / 2
    lagged = F.aggregate(steps, F.lit(0.0),
                         lambda a, i: a + (F.get(values, i) - mid) * (F.get(values, i - 1) - mid))
    spread = F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mid) * (v - mid))
    z_serial = lagged / spread * F.sqrt(n)
    staged = staged.withColumns({"_lm_pc": _q_normal(z_chi), "_lm_pr": p_runs,
                                 "_lm_ps": 2 * _q_normal(F.abs(z_serial))})
    tiny = F.lit(1e-300)
    half = -(F.log(F.greatest("_lm_pc", tiny)) + F.log(F.greatest("_lm_pr", tiny))
             + F.log(F.greatest("_lm_ps", tiny)))
    staged = staged.withColumn("_lm_half", half)
    combined = F.least(F.lit(1.0), F.exp(-F.col("_lm_half")) * (
        1 + F.col("_lm_half") + F.col("_lm_half") * F.col("_lm_half") / 2))
    result = F.struct(F.col("_lm_enc").alias("encoding"), n.cast("long").alias("symbols"),
                      F.col("_lm_pc").alias("p_chi"), F.col("_lm_pr").alias("p_runs"),
                      F.col("_lm_ps").alias("p_serial"), combined.alias("p"))
    return staged.withColumn(out, result).drop(
        "_lm_enc", "_lm_abc", "_lm_sym", "_lm_vals", "_lm_k", "_lm_n", "_lm_sorted", "_lm_ends", "_lm_pc",
        "_lm_pr", "_lm_ps", "_lm_half")


def judged_tokens(tokens: DataFrame, q: float = Q) -> DataFrame:
    """Tokens with ``_lm_test`` (the battery) and ``_lm_random``: not rejected by BH in its class.

    Tokens of fewer than ``MIN_SYMBOLS`` symbols after their encoding's padding is taken off
    are not judged (``_lm_random`` false). Benjamini-Hochberg per length class
    ``floor(log2(symbols))``: the largest p-value with ``p <= q * rank / m`` is the class's
    threshold; ties share the largest rank. An empty table gives an empty result.
    """
    tested = battery(tokens)
    judged = tested.where(F.col("_lm_test.symbols") >= MIN_SYMBOLS).withColumn(
        "_lm_class", F.floor(F.log2(F.col("_lm_test.symbols"))).cast("int"))
    judged = written(judged, "secrets-tested")
    ranked = numbered(judged.select("_lm_class", F.col("_lm_test.p").alias("_lm_p")), "_lm_class",
                      [F.col("_lm_p")])
    # One row per length class: no more than 64 classes, whatever the input.
    limits = ranked.where(F.col("_lm_p") <= q * (F.col("_lm_idx") + 1) / F.col("_lm_n")).groupBy(
        "_lm_class").agg(F.max("_lm_p").alias("_lm_limit"))
    verdict = judged.join(F.broadcast(limits), "_lm_class", "left").withColumn(
        "_lm_random", F.col("_lm_limit").isNull() | (F.col("_lm_test.p") > F.col("_lm_limit")))
    short = tested.where(F.col("_lm_test.symbols") < MIN_SYMBOLS).withColumn("_lm_random", F.lit(False))
    return verdict.drop("_lm_class", "_lm_limit").unionByName(short)


def _listed(spans: Column) -> Column:
    ranked = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"),
        F.array_position(F.array(*[F.lit(k) for k in [*KINDS, RANDOM]]), s["kind"]).alias("rank"),
        s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(ranked), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """The rows with ``n_assign``, ``n_access``, ``n_hex``, ``n_random``, ``base`` and ``spans``.

    ``base`` and ``spans`` are lists of "kind:start:end" (code points, end exclusive) by
    start, then kind as listed (assign, access, hex, random), comma-joined; ``spans`` adds the
    method's tokens that overlap no base span. A null text is empty. Rows with the same id
    and text are one document, each returned; a null id is a document of its own text. Columns
    of the result's names replace the input's. An empty table gives an empty result.
    """
    found = written(found_spans(docs, id_col, text_col), "secrets-found")
    base = found.where(F.col("kind").isin(*KINDS) & F.col("passes"))
    tokens = judged_tokens(found.where(F.col("kind") == "token"), q).where("_lm_random")
    span = F.struct("kind", "start", "end")
    per_doc = base.select("_lm_id", "_lm_text", span.alias("_lm_s"), F.lit(True).alias("_lm_base")).unionByName(
        tokens.select("_lm_id", "_lm_text", F.struct(F.lit(RANDOM).alias("kind"), "start", "end").alias("_lm_s"),
                      F.lit(False).alias("_lm_base")))
    per_doc = per_doc.groupBy("_lm_id", "_lm_text").agg(
        F.collect_list(F.when(F.col("_lm_base"), F.col("_lm_s"))).alias("_lm_b"),
        F.collect_list(F.when(~F.col("_lm_base"), F.col("_lm_s"))).alias("_lm_r"))
    added = F.filter("_lm_r", lambda r: ~F.exists("_lm_b", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    per_doc = per_doc.select("_lm_id", "_lm_text", "_lm_b", added.alias("_lm_r"))
    id_key, text_key = doc_key(id_col, text_col)
    names = ["n_assign", "n_access", "n_hex", "n_random", "base", "spans"]
    keep = [c for c in docs.columns if c not in names]
    joined = docs.select(*keep, id_key, text_key).join(per_doc, ["_lm_id", "_lm_text"], "left")
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    b, r = F.coalesce("_lm_b", empty), F.coalesce("_lm_r", empty)
    return joined.select(
        *keep,
        *[_count(b, k).alias(f"n_{k}") for k in KINDS],
        F.size(r).cast("long").alias("n_random"),
        _listed(b).alias("base"), _listed(F.concat(b, r)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"),
                        "spans", "n_random")
