"""Near duplicates by MinHash (operator 4).

1. One scan turns every text into its set of word shingles, a signature of many universal
   hash minima, and the hashes of the signature's bands.
2. Equal sets are one class; only its first document goes on.
3. Documents that share a band meet at the band's hub, the member that meets most others.
   Candidates are compared by signature, then on full sets. Components of these links leave
   few documents of a large group unsettled.
4. What is left of each group of candidates in more than one component is compared with the
   group's other components, in blocks that keep only links between components.
5. Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm.common import documents, ship_with_jobs, text_of, written
from listmill.llm.graph import components

ship_with_jobs(__name__)

SHINGLE_WORDS = 4
SIMILARITY = (80, 100)
BANDS, ROWS = 32, 4
#: A pair whose signatures agree in a smaller share cannot be similar enough: 0.8 less 5.6
#: standard deviations of 128 minima.
MIN_AGREEMENT = 0.6
#: Shingles that a block of documents to compare holds, on average.
BLOCK_SHINGLES = 200_000

_U = np.uint64
_rng = np.random.default_rng(20240)
_MULTIPLY = (_rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << _U(1)) | _U(1)
_ADD = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
_MIX = [_U(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; A-Z count as a-z.

    Fewer words than a shingle has are one shingle; no word gives none.
    """
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in text.lower().split()], dtype=np.uint64)
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - words + 1)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(min(words, len(hashes))):
        part = hashes[i:i + n] if len(hashes) >= words else hashes[i:i + 1]
        total = (total ^ (part * _MIX[i % 4] + _U(i))) * _MIX[(i + 1) % 4]
        total ^= total >> _U(29)
    return np.unique(total + _U(min(words, len(hashes))))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Minima of ``BANDS * ROWS`` functions (a x + b mod 2^64, upper half)."""
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for i in range(0, len(hashes), 2048):
        values = (hashes[None, i:i + 2048] * _MULTIPLY[:, None] + _ADD[:, None]) >> _U(32)
        np.minimum(least, values.min(axis=1).astype(np.uint32), out=least)
    return least


def band_hashes(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[0]
    for i in range(ROWS):
        total = (total ^ rows[:, i]) * _MIX[i % 4]
        total ^= total >> _U(31)
    return total.view(np.int64)


_SETS = "_lm_id bigint, _lm_text bigint, n bigint, low bigint, high bigint, bands array<bigint>, sig binary"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, low, high, bands, sigs = [], [], [], [], []
        for text in batch.column(1):
            hashes = shingles(text.as_py())
            n.append(len(hashes))
            digest = np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), dtype=np.int64)
            low.append(int(digest[0]))
            high.append(int(digest[1]))
            if len(hashes):
                least = signature(hashes)
                bands.append(band_hashes(least))
                sigs.append(least.astype(np.uint8).tobytes())
            else:
                bands.append(None)
                sigs.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()),
             pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
            ["_lm_id", "_lm_text", "n", "low", "high", "bands", "sig"])


class _Block:
    """Documents held in memory, with an index from shingle to documents."""

    def __init__(self):
        self.ids, self.parts, self.sets, self.sigs = [], [], [], []
        self.index = None

    def add(self, ident: int, part: int, hashes: np.ndarray, sig: np.ndarray) -> None:
        self.ids.append(ident)
        self.parts.append(part)
        self.sets.append(hashes)
        self.sigs.append(sig)

    def close(self) -> None:
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        every = np.concatenate(self.sets)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.shingles, self.starts = np.unique(every[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(every))
        self.sigs = np.stack(self.sigs)
        # Union-find over the components that occur here.
        self.root: dict[int, int] = {}
        self.index = True

    def find(self, part: int) -> int:
        root = self.root
        while (up := root.get(part, part)) != part:
            root[part] = root.get(up, up)
            part = up
        return part

    def links(self, ident: int, part: int, hashes: np.ndarray, sig: np.ndarray) -> list[int]:
        """Documents similar enough to one document, one for each component not tied yet."""
        near = (self.sigs == sig).mean(axis=1) >= MIN_AGREEMENT
        if not near.any():
            return []
        own = self.find(part)
        at = np.searchsorted(self.shingles, hashes)
        at[at == len(self.shingles)] = 0
        at = at[self.shingles[at] == hashes]
        lengths = self.ends[at] - self.starts[at]
        places = np.repeat(self.starts[at] - np.append(0, np.cumsum(lengths)[:-1]), lengths) + np.arange(lengths.sum())
        common = np.bincount(self.owner[places], minlength=len(self.ids))
        union = self.sizes + len(hashes) - common
        found = []
        for i in np.flatnonzero(near & (SIMILARITY[1] * common >= SIMILARITY[0] * union)):
            other = self.find(self.parts[i])
            if other != own and self.ids[i] != ident:
                self.root[other] = own
                found.append(self.ids[i])
        return found


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block; in a block, side 0 is held and side 1 is compared with it."""
    current, block = None, None
    for batch in batches:
        us, vs = [], []
        for row in zip(*(c for c in batch.columns)):  # values become Python objects one row at a time
            g1, g2, g3, side, ident, part, text, sig = (x.as_py() for x in row)
            if (g1, g2, g3) != current:
                current, block = (g1, g2, g3), _Block()
            hashes, sig = shingles(text), np.frombuffer(sig, dtype=np.uint8)
            if side == 0:
                block.add(ident, part, hashes, sig)
                continue
            if not block.ids:
                continue
            if block.index is None:
                block.close()
            for other in block.links(ident, part, hashes, sig):
                us.append(ident)
                vs.append(other)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def _verified(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` among rows ``g1``, ``g2``, ``g3`` (a block), ``side``, ``id``, ``part``."""
    blocks = rows.join(texts, "id").select("g1", "g2", "g3", "side", "id", "part", "text", "sig")
    return blocks.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", "side", "id").mapInArrow(
        _compare, "u bigint, v bigint")


def _hubs(bands: DataFrame) -> DataFrame:
    """``hub``, ``id``: each member of a band with two members or more meets the band's hub.

    The hub is the member that meets most documents over all its bands.
    """
    shared = written(bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "bands")
    meeting = written(bands.join(shared, "band"), "meetings")
    reach = meeting.groupBy("id").agg(F.sum("members").alias("reach"))
    ranked = meeting.join(reach, "id").groupBy("band").agg(
        F.max(F.struct("reach", (-F.col("id")).alias("back"))).alias("top"))
    hubs = written(ranked.select("band", (-F.col("top.back")).alias("hub")), "hubs")
    return meeting.join(hubs, "band").where("id <> hub").select("hub", "id").distinct()


def _leftovers(candidates: DataFrame, linked: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """Blocks that compare the smaller components of each group of candidates with the others.

    A group is a component of all candidate pairs. Its largest component of links is ``main``.
    The rest is cut into blocks; each of these meets the blocks of main and of the rest up to
    itself. So a document of main is sent once per block of the rest, which is small where
    the hubs have done their work.
    """
    group = components(candidates.select(F.col("hub").alias("u"), F.col("id").alias("v")))
    rows = (
        group.select(F.col("node").alias("id"), F.col("component").alias("grp"))
        .join(linked.select(F.col("node").alias("id"), F.col("component").alias("tied")), "id", "left")
        .select("grp", "id", F.coalesce("tied", "id").alias("part")).join(sizes, "id"))
    rows = written(rows, "groups")
    parts = rows.groupBy("grp", "part").agg(F.sum("n").alias("weight"), F.count("*").alias("members"))
    groups = parts.groupBy("grp").agg(
        F.max(F.struct("members", F.col("part").alias("p"), "weight")).alias("main"),
        F.sum("weight").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    plan = written(groups.select(
        "grp", F.col("main.p").alias("main"),
        F.ceil(F.col("main.weight") / block).cast("int").alias("main_blocks"),
        F.ceil((F.col("all") - F.col("main.weight")) / block).cast("int").alias("rest_blocks")), "plan")
    dealt = rows.join(plan, "grp").withColumn("is_main", F.col("part") == F.col("main"))
    place = F.when(F.col("is_main"), F.pmod(F.xxhash64("id"), F.col("main_blocks"))).otherwise(
        F.pmod(F.xxhash64("id"), F.col("rest_blocks"))).cast("int")
    dealt = dealt.withColumn("place", place)
    keep = ["grp", "id", "part"]
    main = dealt.where("is_main").select(
        *keep, F.explode(F.sequence(F.lit(0), F.col("rest_blocks") - 1)).alias("g2"),
        (-1 - F.col("place")).alias("g3"), F.lit(1).alias("side"))
    rest = dealt.where("NOT is_main")
    held = rest.select(
        *keep, F.col("place").alias("g2"),
        F.explode(F.sequence(-F.col("main_blocks"), F.col("place"))).alias("g3"), F.lit(0).alias("side"))
    met = rest.select(
        *keep, F.explode(F.sequence(F.col("place"), F.col("rest_blocks") - 1)).alias("g2"),
        F.col("place").alias("g3"), F.lit(1).alias("side"))
    return main.unionByName(held).unionByName(met).select(
        F.col("grp").alias("g1"), "g2", "g3", "side", "id", "part")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_SHINGLES,
) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` for each row.

    Two documents are linked if their sets' intersection is at least 0.8 of the union; a
    component's id is its smallest document. A document without words has an empty set and
    is linked with nothing. Rows with the same id are one document, linked by the sets of
    all of them; each is returned. A row with a null id is linked with nothing, has a null
    component and is kept. An empty table gives an empty result.

    Of 32 bands of 4 minima, a pair of similarity 0.8 shares none with probability 5e-8.
    Shuffled are hashes; texts only of documents that share a band with another, once per
    hub or block they meet. Bands that a third of all documents share are counted before
    they are exchanged, and their members meet one hub in blocks.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("_lm_id"), F.encode(text, "UTF-8").alias("text"), F.xxhash64(text).alias("_lm_text"))
    sets = written(rows.mapInArrow(_describe, _SETS), "sets")
    known = sets.where("_lm_id IS NOT NULL AND n > 0")
    classes = written(
        known.groupBy("low", "high", "n").agg(F.min("_lm_id").alias("first")), "classes")
    members = known.select("_lm_id", "low", "high", "n").join(classes, ["low", "high", "n"]).select(
        F.col("first").alias("u"), F.col("_lm_id").alias("v")).where("u <> v")
    firsts = known.select(F.col("_lm_id").alias("id"), "_lm_text", "low", "high", "n", "bands", "sig").join(
        classes.select("low", "high", "n", F.col("first").alias("id")), ["low", "high", "n", "id"])
    firsts = written(firsts.dropDuplicates(["id", "low", "high"]), "firsts")
    bands = firsts.select("id", F.explode("bands").alias("band"))
    candidates = written(_hubs(bands), "candidates")
    involved = candidates.select(F.col("hub").alias("id")).unionByName(candidates.select("id")).distinct()
    # Rows of one id are told apart by their text; each set is compared.
    keyed = rows.select(F.col("_lm_id").alias("id"), "_lm_text", "text")
    texts = written(
        firsts.join(involved, "id", "left_semi").select("id", "_lm_text", "n", "sig").join(keyed, ["id", "_lm_text"])
        .select("id", "n", "sig", "text"), "texts")
    sizes = texts.groupBy("id").agg(F.sum("n").alias("n"))
    weights = written(
        candidates.join(sizes, "id").groupBy("hub").agg(
            F.ceil(F.sum("n") / block).cast("int").alias("blocks")), "hub-blocks")
    meet = candidates.join(weights, "hub").select(
        F.col("hub").alias("g1"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("g2"),
        F.lit(0).alias("g3"), F.lit(1).alias("side"), "id", F.col("id").alias("part"))
    hubs = weights.select(
        F.col("hub").alias("g1"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("g2"),
        F.lit(0).alias("g3"), F.lit(0).alias("side"), F.col("hub").alias("id"), F.col("hub").alias("part"))
    links = written(_verified(hubs.unionByName(meet), texts.select("id", "text", "sig")), "links")
    linked = components(links)
    rest = _leftovers(candidates, linked, sizes, block)
    more = written(_verified(rest, texts.select("id", "text", "sig")), "more-links")
    final = components(links.unionByName(more).unionByName(members))
    return sets.join(final, F.col("_lm_id") == F.col("node"), "left").select(
        F.col("_lm_id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component", "_lm_id").alias("component_id"),
        F.coalesce(F.coalesce("component", "_lm_id") == F.col("_lm_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: The same by joining all shingles; for tables of some thousand documents.
SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM texts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, least) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT y, least FROM reach JOIN ways ON node = x WHERE least < y),
parts AS (SELECT node, min(least) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN parts ON node = d.doc_id
"""
