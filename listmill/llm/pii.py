"""Personal data by rules and by bootstrapped contexts (operator 3).

Rules find e-mail addresses, IP addresses, card and phone numbers. These are the seeds: the
words around them are patterns. Spark scores the graph of patterns and instances in rounds:
a pattern is as good as the instances it brings, an instance as good as the patterns that
bring it. Instances of good patterns that no rule accepts are identifiers too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm.common import doc_key, documents, ship_with_jobs, text_of, written

ship_with_jobs(__name__)

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; different seed instances that a pattern needs; least score of a
#: pattern that is used and of an instance that is reported.
ROUNDS, MIN_SEEDS, MIN_PATTERN, MIN_INSTANCE = 3, 5, 0.5, 0.8

# The rules. Possessive forms of the patterns, which match the same strings.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: What an identifier that the rules miss may look like, by kind. An e-mail address is a local
#: part, perhaps a blank, and this.
_AT = re.compile(r"(?i:\(at\)|\[at\]| at )")
_LOOSE = {
    "email": re.compile(
        _AT.pattern + r" ?[A-Za-z0-9-]++(?: ?(?i:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]++)++"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,7}(?![0-9A-Za-z:])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.+-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[ ./-]{1,2}[0-9]{2,6}){1,4}(?![0-9A-Za-z])"),
}
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~"
_REACH = 80


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, end)):
            found.append((start, m.end()))
            end = free = m.end()
        else:
            free = end
        at = text.find("@", end)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the rules, by kind, then start; leftmost and non-overlapping in a kind."""
    spans = [("email", *x) for x in _emails(text)]
    if not _DIGIT.search(text):
        return spans
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def _loose_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost spans that do not overlap, from mark to mark: no word is tried from each letter."""
    found, free, at = [], 0, _AT.search(text)
    while at:
        stop = at.start() - (text[at.start() - 1:at.start()] == " ")
        start = stop
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _LOOSE["email"].match(text, at.start()) if free <= start < stop else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = _AT.search(text, m.end() if m else at.start() + 1)
    return found


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans that look like identifiers and overlap no rule's span.

    Nor an earlier loose one, but for e-mail addresses: any prose with "at" may look like
    them, and what they overlap is settled by the scores.
    """
    found = []
    if ":" in text:
        found += [("ip", *m.span()) for m in _LOOSE["ip"].finditer(text)]
    if _DIGIT.search(text):
        found += [
            ("card", *m.span()) for m in _CARD.finditer(text)
            if 13 <= sum(c.isdigit() for c in m.group()) <= 19]
        found += [
            ("phone", *m.span()) for m in _LOOSE["phone"].finditer(text)
            if 7 <= sum(c.isdigit() for c in m.group()) <= 15]
    emails = _loose_emails(text)
    if not found and not emails:
        return []
    kept, taken = [], bytearray(len(text))
    for _, s, e in base:
        taken[s:e] = b"\1" * (e - s)
    kept += [("email", s, e) for s, e in emails if taken.find(1, s, e) < 0]
    for kind, s, e in sorted(found, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if taken.find(1, s, e) < 0:
            kept.append((kind, s, e))
            taken[s:e] = b"\1" * (e - s)
    return kept


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns of a place: the word before, the two before, the words on both sides.

    Words are in lower case without punctuation at their ends; digits become 0.
    """
    def plain(w: str) -> str:
        return re.sub(r"\d", "0", w.strip(_EDGE).lower())

    left = [plain(w) for w in _WORD.findall(text[max(0, start - _REACH):start])[-2:]]
    right = [plain(w) for w in _WORD.findall(text[end:end + _REACH])[:1]]
    made = []
    if left and left[-1]:
        made.append(f"{left[-1]} _")
        if len(left) > 1 and left[0]:
            made.append(f"{left[0]} {left[1]} _")
        if right and right[0]:
            made.append(f"{left[-1]} _ {right[0]}")
    return made


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
_MENTION = pa.struct([
    ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.bool_()),
    ("value", pa.string()), ("patterns", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, mentions = [], []
        for text in batch.column(1):
            text = text.as_py()
            base = base_spans(text)
            loose = loose_spans(text, base)
            spans.append([dict(zip(("kind", "start", "stop"), s)) for s in base])
            mentions.append([
                {"kind": k, "start": s, "stop": e, "seed": seed, "value": text[s:e].lower(), "patterns": contexts(text, s, e)}
                for seed, group in ((True, base), (False, loose)) for k, s, e in group])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(spans, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))],
            ["_lm_id", "_lm_text", "base", "mentions"])


def pattern_scores(edges: DataFrame, rounds: int, min_seeds: int, min_pattern: float) -> DataFrame:
    """``kind``, ``value``, ``score`` of instances that are no seeds, after some rounds.

    ``edges``: distinct ``kind``, ``pattern``, ``value``, ``seed``. A seed scores 1. A pattern
    with at least ``min_seeds`` different seeds scores the mean of its instances, times its
    purity, the share of its kind among all its seeds and one more: words that stand before
    identifiers of every kind say little. An instance scores 1 minus the product of what its
    patterns of at least ``min_pattern`` leave open.
    Frequent patterns and instances are aggregated before they are exchanged; every join is
    of edges with one row per pattern or instance.
    """
    useful = edges.groupBy("kind", "pattern").agg(
        F.count_if("seed").alias("seeds"), F.count_if(~F.col("seed")).alias("others"))
    seen = useful.groupBy("pattern").agg(F.sum("seeds").alias("all_seeds"))
    useful = useful.where((F.col("seeds") >= min_seeds) & (F.col("others") > 0)).join(seen, "pattern").withColumn(
        "purity", F.col("seeds") / (F.col("all_seeds") + 1))
    graph = written(edges.where("NOT seed").join(useful, ["kind", "pattern"]), "pii-graph")
    scores = graph.select("kind", "value", F.lit(0.0).alias("score")).distinct()
    for _ in range(rounds):
        brought = graph.join(scores, ["kind", "value"])
        patterns = brought.groupBy("kind", "pattern").agg(
            (F.first("purity") * (F.sum("score") + F.first("seeds")) / (F.first("seeds") + F.first("others"))).alias("p"))
        used = patterns.where(F.col("p") >= min_pattern)
        scores = written(
            graph.join(used, ["kind", "pattern"]).groupBy("kind", "value").agg(
                (1.0 - F.exp(F.sum(F.log(1.0 - F.least("p", F.lit(0.999)))))).alias("score"))
            .unionByName(graph.select("kind", "value", F.lit(0.0).alias("score")))
            .groupBy("kind", "value").agg(F.max("score").alias("score")), "pii-scores")
    return scores


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
    min_seeds: int = MIN_SEEDS, min_pattern: float = MIN_PATTERN, min_instance: float = MIN_INSTANCE,
) -> DataFrame:
    """``id_col``, ``base`` and ``added`` for each row: arrays of ``kind``, ``start``, ``stop``.

    Offsets are code points, ends exclusive; both arrays are ordered by kind as listed, then
    start. Added spans overlap neither those of the rules nor each other: the best score, then
    the first counts. A null text has no span; a null id
    stays null; rows that agree in id and text get equal results, each is returned; an empty
    table gives none. Whole texts are read in one scan that keeps spans and contexts only;
    texts are never exchanged.
    """
    _, text_key = doc_key(id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_lm_id"), text_of(text_col).alias("t"), text_key)
    scanned = written(rows.mapInArrow(
        _scan, "_lm_id bigint, _lm_text bigint, base array<struct<kind string, start int, stop int>>, mentions "
        "array<struct<kind string, start int, stop int, seed boolean, value string, patterns array<string>>>"), "pii-mentions")
    mentions = scanned.select("_lm_id", "_lm_text", F.explode("mentions").alias("m")).select("_lm_id", "_lm_text", "m.*")
    edges = mentions.select("kind", F.explode("patterns").alias("pattern"), "value", "seed").groupBy(
        "kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    good = pattern_scores(edges, rounds, min_seeds, min_pattern).where(F.col("score") >= min_instance)
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = "array<struct<o:bigint,start:int,stop:int,kind:string>>"
    ranked = F.sort_array(F.collect_set(F.struct(
        (-F.col("score")).alias("rank"), F.col("start").alias("at"), F.struct(order.alias("o"), "start", "stop", "kind").alias("x"))))
    apart = F.aggregate("ranked", F.array().cast(span), lambda kept, r: F.when(
        F.exists(kept, lambda k: (k["start"] < r["x"]["stop"]) & (r["x"]["start"] < k["stop"])), kept,
    ).otherwise(F.concat(kept, F.array(r["x"]))))
    added = (
        mentions.where("NOT seed").join(good, ["kind", "value"])
        .groupBy(F.coalesce("_lm_id", F.lit(2**63 - 1)).alias("_lm_i"), F.col("_lm_text").alias("_lm_t"))
        .agg(ranked.alias("ranked")).select("_lm_i", "_lm_t", F.sort_array(apart).alias("a")))
    joined = scanned.join(
        added, (F.coalesce("_lm_id", F.lit(2**63 - 1)) == F.col("_lm_i")) & (F.col("_lm_text") == F.col("_lm_t")), "left")
    return joined.select(
        F.col("_lm_id").alias(id_col), "base",
        F.transform(F.coalesce("a", F.array().cast(span)),
                    lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))).alias("added"))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir))
    order = F.array(*map(F.lit, KINDS))
    both = F.transform(F.array_sort(F.transform(
        F.concat("base", "added"),
        lambda x: F.struct(F.array_position(order, x["kind"]).alias("o"), x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    kinds = F.transform("base", lambda x: x["kind"])
    counts = {f"n_{k}": (F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long") for k in KINDS}
    return found.select(
        "doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(_listed("base"), 256).alias("base_sha256"),
        _listed(both).alias("spans"), F.size("added").cast("long").alias("n_added"))
