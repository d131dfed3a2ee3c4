"""Merkle manifest (operator 12) against a plain tree built in Python."""

import hashlib
import zlib

from listmill.llm import manifest


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    if value is None:
        return "-"
    text = str(value)
    return f"{len(text.encode())}:{text}"


def leaf(row):
    return H("".join(field(v) for v in row))


def runs(nodes, fan_out=16):
    return [nodes[i:i + fan_out] for i in range(0, len(nodes), fan_out)]


def tree(nodes, fan_out=16):
    """Top and, per position, the (left, right) text at each level up."""
    paths = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        groups = runs(nodes, fan_out)
        for i, at in enumerate(where):
            run = groups[at // fan_out]
            slot = at % fan_out
            paths[i].append(("".join(run[:slot]), "".join(run[slot + 1:])))
        nodes = [H("".join(g)) for g in groups]
        where = [at // fan_out for at in where]
    return nodes[0], paths


def brute(rows, fan_out=16):
    """{doc_id: (leaf, subroot, root, proof, folded)} for rows (doc_id, source, lang, n_chars, text)."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    keys = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs, paths = {}, {}
    for s in keys:
        ordered = sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[s], p = tree([leaf(r) for r in ordered], fan_out)
        for r, q in zip(ordered, p):
            paths[r[0]] = q
    root, upper = tree([subs[s] for s in keys], fan_out)
    out = {}
    for s, up in zip(keys, upper):
        for r in by_source[s]:
            path = paths[r[0]] + up
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            acc = leaf((*r[:4], text))
            for left, right in path:
                acc = H(left + acc + right)
            proof = H("".join(a + b for a, b in path))
            out[r[0]] = (leaf(r), subs[s], root, proof, acc)
    return out


def _check(result, rows):
    want = brute(rows)
    assert len(result) == len(rows)
    for r in result:
        got = (r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"])
        assert got == want[r["doc_id"]], r["doc_id"]
        assert r["verified"] == (r["folded_root"] == r["root"])


def test_query_against_plain_tree(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*manifest.COLUMNS).collect()]
    result = manifest.query(spark, sf).collect()
    _check(result, rows)
    assert any(not r["verified"] for r in result) and any(r["verified"] for r in result)


def _query_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    frame = frame.repartition(4).withColumn("t", manifest.tampered(frame))
    frame = frame.withColumn("changed", manifest.leaf_of(["doc_id", "source", "lang", "n_chars", "t"]))
    built = manifest.manifest(frame, manifest.COLUMNS, carry=["doc_id", "changed"])
    return built.select(
        "doc_id", "leaf", "subroot", "root", manifest.proof(built["path"]).alias("proof_sha256"),
        manifest.fold(built["changed"], built["path"]).alias("folded_root"),
    ).withColumn("verified", manifest.F.col("folded_root") == manifest.F.col("root")).collect()


def test_levels_sizes_and_groups(spark):
    """A hot source of 300 leaves (three levels), one of 16, 17 and 1, a null and an empty source."""
    rows = [(i, "hot", "en", i, f"Text {i} ABC") for i in range(300)]
    rows += [(1000 + i, "b", None, None, None if i % 3 else "Q") for i in range(16)]
    rows += [(2000 + i, "é", "fr", 3, "x") for i in range(17)]
    rows += [(3000, "lone", "de", 1, "A"), (3001, None, None, None, None), (3002, "", "x", 0, "")]
    _check(_query_rows(spark, rows), rows)


def test_one_row_and_none(spark):
    rows = [(7, "s", "en", 5, "Hello")]
    result = _query_rows(spark, rows)
    assert result[0]["leaf"] == result[0]["subroot"] == result[0]["root"]
    _check(result, rows)
    assert _query_rows(spark, rows[:0]) == []


def test_clashing_columns_stay(spark):
    frame = spark.createDataFrame([(1, "a", "x", "old", "p")], "doc_id bigint, source string, text string, leaf string, path string")
    built = manifest.manifest(frame, ["doc_id", "source", "text"]).collect()[0]
    assert built["leaf"] == leaf((1, "a", "x")) and built["root"] == built["leaf"]
