"""Operators that bring rows together."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from listmill.llm import decontaminate, fixity, graph, lines, mixing, neardup, quotes, sharding

DOC = "doc_id bigint, text string"


def _ids(result):
    return Counter(r["doc_id"] for r in result)


# Line dedup

def test_line_dedup(spark, sf, texts):
    result = lines.query(spark, sf).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in result} == brute.line_dedup(texts.items())


def test_line_dedup_odd_rows(odd, none, odd_rows):
    result = lines.drop_shared_lines(odd).collect()
    assert _ids(result) == Counter(r[0] for r in odd_rows)
    got = {(r["doc_id"], r["text"]): (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in result}
    assert got[1, odd_rows[0][1]][1] == 0  # the first holder, also where its row is repeated
    assert got[2, odd_rows[0][1]] == (1, 1, "") == got[None, odd_rows[0][1]]
    assert got[3, None] == (1, 0, "") == got[4, ""]
    assert got[12, odd_rows[14][1]][1] == 0 and got[13, "same line of text"][1] == 1
    assert lines.drop_shared_lines(none).count() == 0


# Near duplicates

def test_near_duplicates(spark, sf, texts):
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    wanted = brute.components(sets)
    for r in neardup.query(spark, sf).collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), wanted[i], wanted[i] == i)


def test_hard_group_of_near_copies(spark):
    """Many variants of one text, most pairs just above or below the bound, in tiny blocks."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(words)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(120)] = f"v{rng.randrange(9)}"
        rows.append((i * 3 % 151, " ".join(text)))
    wanted = brute.components({i: brute.shingles(t) for i, t in rows})
    assert 2 < len(set(wanted.values())) < 100
    result = neardup.near_duplicates(spark.createDataFrame(rows, DOC).repartition(4), block=2_000).collect()
    assert {r["doc_id"]: r["component_id"] for r in result} == wanted


def test_near_duplicates_odd_rows(odd, none, odd_rows):
    result = neardup.near_duplicates(odd).collect()
    assert _ids(result) == Counter(r[0] for r in odd_rows)
    parts = {r["doc_id"]: r["component_id"] for r in result}
    assert (parts[2], parts[7], parts[9], parts[3], parts[None]) == (1, 6, 8, 3, None)
    assert all(r["kept"] for r in result if r["doc_id"] in (None, 1, 3, 4, 5)) and not any(
        r["kept"] for r in result if r["doc_id"] in (2, 7, 9))
    assert all(r["n_shingles"] == 0 for r in result if r["doc_id"] in (3, 4, 5))
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 120)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    wanted = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    result = graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert {r["node"]: r["component"] for r in result} == wanted and len(result) == len(wanted)


def test_a_band_is_missed_by_few_similar_pairs():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(300):
        base = rng.integers(0, 2**64, 180, dtype=np.uint64)
        a, b = np.sort(base[:162]), np.sort(base[18:])  # 144 of 180
        missed += not (neardup.band_hashes(neardup.signature(a)) == neardup.band_hashes(neardup.signature(b))).any()
    assert missed == 0


# Sharding

def test_shards_hold_every_row_once(spark, sf, texts):
    result = sharding.query(spark, sf).collect()
    assert _ids(result) == Counter(list(texts))
    slots = defaultdict(list)
    for r in result:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_of_odd_rows(odd, none, odd_rows):
    result = sharding.shuffle_to_shards(odd, n_shards=5, block_rows=2).collect()
    assert _ids(result) == Counter(r[0] for r in odd_rows)
    assert sorted(Counter(r["shard"] for r in result).values()) == [3, 3, 3, 3, 4]
    assert len({(r["shard"], r["slot"]) for r in result}) == len(odd_rows)
    assert sharding.shuffle_to_shards(none).count() == 0


def test_shuffle_is_uniform(spark):
    """Where a row goes and which slot it gets depends on neither its place nor its partition."""
    rows = spark.range(0, 12, 1, 3)
    shards, slots = np.zeros((12, 4)), np.zeros((12, 3))
    for seed in range(30):
        for r in sharding.shuffle_to_shards(rows, n_shards=4, seed=seed, block_rows=1).collect():
            shards[r["id"], r["shard"]] += 1
            slots[r["id"], r["slot"]] += 1
    assert ((shards - 7.5) ** 2 / 7.5).sum() < 80 and ((slots - 10) ** 2 / 10).sum() < 60


def test_matrix_margins_and_law():
    rng = np.random.default_rng(3)
    sizes, shards = [5, 0, 40, 1, 17], [13, 12, 0, 25, 13]
    matrix = np.array(sharding.communication_matrix(sizes, shards, 7))
    assert matrix.sum(axis=1).tolist() == sizes and matrix.sum(axis=0).tolist() == shards and matrix.min() >= 0
    ours = np.bincount([sharding.hypergeometric(rng, 7, 9, 6) for _ in range(4000)], minlength=7)
    theirs = np.bincount(rng.hypergeometric(7, 9, 6, 400_000), minlength=7) / 100
    assert (((ours - theirs) ** 2)[:6] / theirs[:6]).sum() < 25
    huge = sharding.hypergeometric(rng, 10**12, 3 * 10**12, 10**11)
    assert abs(huge - 25 * 10**9) < 10 * (10**11 * 3 / 16) ** 0.5


# Mixing

def test_mix(spark, sf, docs, texts):
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {i: len(brute.WORD.findall(t)) for i, t in texts.items()}
    totals, taken = Counter(), Counter()
    for i, s in sources.items():
        totals[s] += size[i]
    wanted = brute.targets(totals)
    result = mixing.query(spark, sf).collect()
    assert _ids(result) == Counter(list(texts))
    for r in result:
        i = r["doc_id"]
        s = sources[i]
        assert r["size"] == size[i] and r["source_size"] == totals[s] and r["taken"] in [k * size[i] for k in range(4)]
        assert r["target"] == pytest.approx(wanted[s])
        taken[s] += r["taken"]
    longest = max(size.values())
    assert all(abs(taken[s] - wanted[s]) <= longest for s in totals) and sum(taken.values()) <= sum(totals.values())
    again = mixing.query(spark, sf).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, result))


def test_mix_in_order(docs):
    mixed = mixing.mix(docs)
    result = mixing.in_order(mixed, [*docs.columns, "size", "target", "source_size"]).collect()
    assert len(result) == mixed.agg({"copies": "sum"}).first()[0]
    # In any prefix, sources that are not used up stand in the ratio of their weights.
    names, weights = sorted({r["source"] for r in docs.collect()}), (5, 2, 1)
    sent, half = Counter(), sum(r["size"] for r in result) // 4
    for r in result:
        sent[r["source"]] += r["size"]
        if sum(sent.values()) > half:
            break
    open_ones = [s for s in names if sent[s] < 2 * next(r["source_size"] for r in result if r["source"] == s)]
    levels = [sent[s] / weights[names.index(s) % 3] for s in open_ones]
    assert max(levels) - min(levels) < 4000


def test_mix_odd_rows(odd, none, odd_rows):
    result = mixing.mix(odd).collect()
    assert _ids(result) == Counter(r[0] for r in odd_rows)
    totals = Counter()
    for _, text, source in odd_rows:
        totals[source] += len(brute.WORD.findall(text or ""))
    wanted = brute.targets(dict(totals))
    assert all(r["target"] == pytest.approx(wanted[r["source"]]) for r in result)
    assert all(0 <= r["copies"] <= 3 for r in result)
    assert mixing.mix(none).count() == 0
    wordless = odd.where("doc_id IN (3, 4, 5)")
    assert [r["taken"] for r in mixing.mix(wordless).collect()] == [0, 0, 0]


# Decontamination

def test_overlaps(spark, sf, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    some = {i: texts[i] for i in sorted(texts)[:60]}
    frame = spark.createDataFrame(list(some.items()), DOC)
    result = decontaminate.overlaps(frame, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert {(r["doc_id"], r["item_id"]): r["equal"] for r in result} == brute.overlaps(some.items(), items)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SEEDS, 0])
def test_substitutions(spark, limit):
    rng = random.Random(9)
    items = [(n, " ".join(f"i{n}w{j}" for j in range(n))) for n in (3, 4, 5, 8, 9, 12, 13, 15, 16, 30)]
    docs = []
    for n, item in items:
        for changes in range(5):
            for _ in range(3):
                words = item.split()
                for j in rng.sample(range(n), min(n, changes)):
                    words[j] = "changed"
                docs.append((len(docs), "Before it, " + ", ".join(words).upper() + " and after."))
    docs += [(None, docs[-15][1]), (None, None), (5000, "")]
    benchmark = spark.createDataFrame([*items, (77, None), (78, ""), (30, items[-1][1])], "item_id bigint, text string")
    result = decontaminate.overlaps(spark.createDataFrame(docs, DOC), benchmark, broadcast_seeds=limit).collect()
    wanted = brute.overlaps([d for d in docs if d[0] is not None], items)
    assert {(r["doc_id"], r["item_id"]): r["equal"] for r in result if r["doc_id"] is not None} == wanted
    assert [(r["item_id"], r["equal"]) for r in result if r["doc_id"] is None] == [(30, 16)]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SEEDS, 0])
def test_items_that_share_an_id(spark, limit):
    """A short item that is held whole counts, whatever long item has the same id or none too."""
    short, long, other = ([f"{k}{j}" for j in range(n)] for k, n in (("s", 8), ("l", 30), ("o", 16)))
    items = [(i, " ".join(words)) for i in (1, None) for words in (short, long, other)] + [(2, " ".join(long))]
    rows = [
        (10, [*short, "between", *long[3:10], *["rest"] * 20]), (11, long[3:10]), (12, [*short[:7], *long[:8]]), (13, [*other, "and", *short]),
        (14, [*long[:20], *short[:5]]), (None, [*short, *other[:6]])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], DOC)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    result = decontaminate.overlaps(docs, benchmark, broadcast_seeds=limit).collect()
    assert Counter((r["doc_id"], r["item_id"], r["window"], r["equal"]) for r in result) == Counter(
        (d, i, n, n) for d, n in ((10, 8), (13, 16), (13, 8), (14, 16), (None, 8)) for i in (1, None)) + Counter([(14, 2, 16, 16)])
    assert Counter(r["doc_id"] for r in decontaminate.remove(docs, benchmark, broadcast_seeds=limit).collect()) == {11: 1, 12: 1}


#: All seeds at once, in parts, and by exchange.
LIMITS = [decontaminate.BROADCAST_SEEDS, 400, 0]


@pytest.mark.parametrize("limit", LIMITS)
def test_few_words_in_many_places(spark, limit):
    """Words that come again and again: windows at all ends of items and documents."""
    rng = random.Random(31)

    def text(least, most):
        return " ".join(rng.choice("ab") for _ in range(rng.randint(least, most)))

    items = [(n, text(4, 34)) for n in range(40)]
    docs = [(n, text(0, 60)) for n in range(60)]
    docs += [(60 + n, " ".join([text(0, 3), item[rng.randrange(4) * 2:], text(0, 3)])) for n, item in items]
    wanted = brute.overlaps(docs, items)
    assert len(wanted) > 1_000 and {*wanted.values()} > {5, 8, 11, 13, 14, 15, 16}
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    result = decontaminate.overlaps(spark.createDataFrame(docs, DOC), benchmark, broadcast_seeds=limit).collect()
    assert {(r["doc_id"], r["item_id"]): r["equal"] for r in result} == wanted and len(result) == len(wanted)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SEEDS, 800])
def test_a_long_document_full_of_hits(spark, limit):
    """A phrase that a long document repeats and many items hold: no hit keeps the document's tokens."""
    phrase = "which of the following is"
    items = [(n, " ".join([phrase, *(f"i{n}w{j}" for j in range(15))])) for n in range(40)]
    docs = [(1, f"{phrase} " * 6_000 + items[7][1]), (2, f"{phrase} of the")]
    benchmark = spark.createDataFrame([*items, (99, f"{phrase} {phrase}")], "item_id bigint, text string")
    result = decontaminate.overlaps(spark.createDataFrame(docs, DOC), benchmark, broadcast_seeds=limit).collect()
    assert sorted((r["doc_id"], r["item_id"], r["window"], r["equal"]) for r in result) == [(1, 7, 16, 16), (1, 99, 10, 10)]


def test_removal(spark, odd, none, odd_rows):
    benchmark = spark.createDataFrame([(1, odd_rows[0][1])], "item_id bigint, text string")
    left = decontaminate.remove(odd, benchmark)
    assert left.columns == odd.columns
    assert _ids(left.collect()) == Counter(i for i, t, _ in odd_rows if t != odd_rows[0][1])
    assert decontaminate.remove(none, benchmark).count() == 0
    assert decontaminate.remove(odd, benchmark.limit(0)).count() == len(odd_rows)


# Fixity

RECORD = "file string, at bigint, size bigint, id bigint, content string"


def test_audit(spark):
    rows = [(f"f{f}", 100 * i, 90, 1000 * f + i, f"record {f} {i}") for f in range(6) for i in range(200)]
    first = spark.createDataFrame(rows, RECORD)
    damaged, wanted = [], {}
    for r in rows:
        if r[3] == 1005:
            damaged.append((*r[:4], "other"))
            wanted[r[3]] = "altered"
        elif r[3] in (2199, 2000):
            wanted[r[3]] = "lost"
        elif r[3] == 3100:
            damaged.append((*r[:2], 70, r[3], "short"))
            wanted[r[3]] = "resized"
        else:
            damaged.append(r)
    damaged.append(("f4", 95, 4, 4999, "new"))
    wanted[4999] = "extra"
    result = fixity.audit(first, spark.createDataFrame(damaged, RECORD), range_bytes=500, fanout=3).collect()
    assert {r["id"]: r["fault"] for r in result} == wanted
    # 40 ranges a file: a root, then three children a level, not all 40.
    assert all(r["nodes_compared"] <= 1 + 2 * 3 * 4 for r in result)
    assert fixity.audit(first, first, range_bytes=500, fanout=3).count() == 0


def test_audit_of_odd_records(spark):
    rows = [("f", 0, 5, 1, None), ("f", 0, 5, 1, None), (None, None, None, None, "x"), ("g", 7, 3, 2, ""), ("h", 0, 9, 3, "y" * 10**6)]
    full, nothing = spark.createDataFrame(rows, RECORD), spark.createDataFrame([], RECORD)
    assert fixity.audit(full, full).count() == 0 == fixity.audit(nothing, nothing).count()
    assert Counter(r["fault"] for r in fixity.audit(full, nothing).collect()) == {"lost": 5}
    assert Counter(r["fault"] for r in fixity.audit(nothing, full).collect()) == {"extra": 5}
    once = spark.createDataFrame(rows[1:], RECORD)
    assert [(r["id"], r["fault"]) for r in fixity.audit(full, once).collect()] == [(1, "lost")]


# Quotes

def test_parse():
    text = "Hello.\n\nJo wrote:\n>> deep one\n> first\n> first goes on\n>\n> second\nMine.\nMore.\n\n"
    own, passages = quotes.parse(text)
    assert own == "Hello.\n\nMine.\nMore."
    assert passages == [
        (0, "Hello."), (2, "deep one"), (1, "first\nfirst goes on"), (1, "second"), (0, "Mine.\nMore.")]


MAIL = "box bigint, seq bigint, body string"


def test_links(spark):
    rows = [
        (1, 1, "Original idea.\nWith two lines."), (1, 2, "Original idea.\nWith two lines."),  # a copy is not the original
        (1, 3, "> original   IDEA.\n> With two lines.\n\nI agree."), (1, 4, ">> Original idea.\n> I agree.\nMe too."),
        (1, 5, "> With two lines.\nOnly half."), (1, 6, ">> I agree.\nQuote of a quote."), (1, 7, "> Never said.\nHm."),
        (1, 8, "> Me too.\n> Only half.\n> and more\nLongest wins."), (2, 9, "> I agree.\nOther box."),
        (1, 9, None), (None, 3, "> I agree."), (1, None, "> I agree."), (1, 10, "> Me too.\nX."), (1, 10, "> Me too.\nX."),
    ]
    result = quotes.link(spark.createDataFrame(rows, MAIL), "box", "seq", "body").collect()
    assert len(result) == len(rows)
    got = {(r["box"], r["seq"]): (r["parent"], r["root"], r["depth"]) for r in result}
    assert got == {
        (1, 1): (None, 1, 0), (1, 2): (None, 2, 0), (1, 3): (1, 1, 1), (1, 4): (3, 1, 2), (1, 5): (1, 1, 1), (1, 6): (3, 1, 2),
        (1, 7): (None, 7, 0), (1, 8): (5, 1, 2), (2, 9): (None, 9, 0), (1, 9): (None, 9, 0), (None, 3): (None, 3, 0),
        (1, None): (None, None, 0), (1, 10): (4, 1, 3)}
    assert {r["own"] for r in result if r["seq"] == 3 and r["box"]} == {"I agree."}
    assert quotes.link(spark.createDataFrame([], MAIL), "box", "seq", "body").count() == 0


@pytest.mark.parametrize("many", [quotes.MANY, 1])
def test_repeated_turns(spark, many):
    """Turns whose texts occurred before are answered like any other."""
    said = {
        1: ["Start.", "Why?", "So.", "Yes.", "Then what?", "Yes.", "Sure?", "Fine.", "Why?", "Yes.", "Good.", "Bye."],
        2: ["A.", "B."] * 4, 3: ["Same."] * 6, 4: ["One.\nSig", "Two.\nSig", "One.\nSig", "Three.\nSig", "Two.\nSig", "Sig"]}
    turns = [(c, t, "user", text) for c, texts in said.items() for t, text in enumerate(texts)]
    frame = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    for r in quotes.link(quotes.mails(frame), "conv_id", "turn", "mail", many=many).collect():
        assert (r["parent"], r["root"], r["depth"]) == (r["turn"] - 1 if r["turn"] else None, 0, r["turn"]), r


def test_last_writer_before(spark):
    rng, size = random.Random(2), quotes.RANGE
    writers = sorted({rng.randrange(9 * size) for _ in range(12)} | {3 * size, 4 * size - 1})
    asked = sorted({rng.randrange(9 * size) for _ in range(60)} | {3 * size, 4 * size, writers[0]})
    result = quotes._last_before(
        spark.createDataFrame([(1, w) for w in writers], "k int, writer bigint"),
        spark.createDataFrame([(1, a) for a in asked] + [(2, 5)], "k int, _lm_seq bigint"), ["k"]).collect()
    assert {r["_lm_seq"]: r["writer"] for r in result} == {
        a: max(w for w in writers if w < a) for a in asked if a > writers[0]}


def test_conversations_come_back(spark, sf):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    turns_frame = spark.read.parquet(f"{sf}/conversations.parquet")
    for r in quotes.link(quotes.mails(turns_frame), "conv_id", "turn", "mail").collect():
        assert r["own"] == turns[r["conv_id"], r["turn"]].strip("\n")
        assert (r["parent"], r["root"], r["depth"]) == (r["turn"] - 1 if r["turn"] else None, 0, r["turn"])
