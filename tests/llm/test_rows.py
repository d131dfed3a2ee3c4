"""Operators that look at one row at a time: quality rules, personal data, token counts."""

import hashlib
import re
from collections import Counter

import public_tokenizers
import pytest
from brute import base_spans, quality_base
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from listmill.llm import pii, quality, tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _same_rows(result, rows):
    assert Counter(r["doc_id"] for r in result) == Counter(r[0] for r in rows)


def test_quality_base(spark, sf, texts):
    for r in quality.query(spark, sf).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert got == quality_base(texts[r["doc_id"]]), r["doc_id"]


def test_quality_odd_rows(odd, none, odd_rows):
    result = quality.clean(odd).collect()
    _same_rows(result, odd_rows)
    by_id = {r["doc_id"]: r for r in result}
    for i, text, _ in odd_rows:
        if i is not None:
            assert (by_id[i]["n_words"], by_id[i]["n_repeat_words"]) == (quality_base(text)[0], quality_base(text)[4])
    assert by_id[6]["kept"] and not by_id[3]["kept"] and by_id[3]["loss"] == 0
    assert quality.clean(none).count() == 0
    kept = quality.kept_rows(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [6, 7]


@pytest.mark.parametrize("line, fault", [
    ("This is a sentence.", None), ("Is it “so?”", None), ("no end at all", "punctuation"),
    ("Home | About | Contact.", "navigation"), ("Sign in", "navigation"), ("Back to top.", "navigation"),
    ("We value you. See our Privacy Policy.", "boilerplate"), ("wow!! so!! loud!! all!!", "punctuation"),
    ("a### b*** c%%% d$$$.", "punctuation"), ("It ends early. then goes on", None),
])
def test_line_rules(spark, line, fault):
    row = spark.createDataFrame([(line,)], "line string").select(quality.line_fault(quality.F.col("line")).alias("f")).first()
    assert row["f"] == fault


def test_lossy_documents_are_rejected(spark):
    prose = " ".join(f"Word{i} goes on." for i in range(40))
    menu = " ".join(f"Word{i} goes |" for i in range(40))
    rows = [(1, prose), (2, f"{prose}\n{menu}\n{menu}"), (3, f"{prose}\n{menu[:200]}")]
    result = quality.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["kept"], r["n_lines_removed"]) for r in result} == {1: (True, 0), 2: (False, 2), 3: (True, 1)}
    assert {r["doc_id"]: r["cleaned"] for r in result}[3] == prose


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.%+-0123456789 ()é:\n", max_size=60))
def test_base_rules(text):
    assert pii.base_spans(text) == base_spans(text)


def test_pii(spark, sf, texts):
    for r in pii.query(spark, sf).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(listed.split(",")) <= set(r["spans"].split(","))


def test_contexts_find_what_rules_miss(spark):
    said = [(i, f"Filler text. Reach our office by dialling +1 (555) 010-{2000 + i} today please.") for i in range(8)]
    said += [(20, "Reach our office by dialling (555) 010-7788 today please."), (21, "It grew to (555) 010-9999 units.")]
    found = pii.find(spark.createDataFrame(said, "doc_id bigint, text string")).collect()
    added = {r["doc_id"]: [tuple(s) for s in r["added"]] for r in found}
    text = dict(said)[20]
    assert added[20] == [("phone", text.index("("), text.index(" today"))]
    assert not added[21] and not any(added[i] for i in range(8))


_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]++)++", re.IGNORECASE)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([" ", " at ", "(AT)", "[at]", " DOT ", ".", "(dot)", "john", "a", "é", "-", "at", "dot", "1"]), max_size=14))
def test_loose_emails_need_no_other_word(parts):
    text = "".join(parts)
    assert pii._loose_emails(text) == [m.span() for m in _EMAIL.finditer(text)]


def test_loose_spans_of_texts_without_digits(spark):
    assert pii.loose_spans("write to john (at) example.com", []) == [("email", 9, 30)]
    assert pii.loose_spans("ask john at example.com", []) == [("email", 4, 23)]
    texts = [(i, f"Kindly write to user{chr(97 + i)}@example.com today.") for i in range(8)]
    texts += [(20, "Kindly write to john (at) example.com today."), (21, "Kindly write to JOHN [AT] EXAMPLE DOT COM today.")]
    texts += [(30 + i, f"The peer node has ab::{i}:1:2:3 or 10.0.0.{i} online.") for i in range(8)]
    found = {r["doc_id"]: r["added"] for r in pii.find(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert [tuple(s) for s in found[20]] == [("email", 16, 37)] and [tuple(s) for s in found[21]] == [("email", 16, 41)]
    (mention,) = pii.loose_spans("peer fe:ab:cd:ef:aa up", [])
    assert mention == ("ip", 5, 19)


def test_prose_with_at_hides_no_number(spark):
    said = [(i, f"Please phone us at +1 (555) 010-{2000 + i} today please.") for i in range(8)]
    said += [(20, "Please phone us at 555.010.7788 today please.")]
    found = {r["doc_id"]: r["added"] for r in pii.find(spark.createDataFrame(said, "doc_id bigint, text string")).collect()}
    assert [tuple(s) for s in found[20]] == [("phone", 19, 31)]


def test_pii_odd_rows(odd, none, odd_rows):
    result = pii.find(odd).collect()
    _same_rows(result, odd_rows)
    assert all(r["base"] == [] and r["added"] == [] for r in result)
    assert pii.find(none).count() == 0


def _library():
    return Tokenizer.from_file(VOCABULARY)


def test_token_counts(spark, sf, texts):
    library = _library()
    for r in tokens.query(spark, sf).collect():
        text = texts[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 2048)


def test_token_counts_of_odd_rows(odd, none, odd_rows):
    library = _library()
    result = tokens.count_tokens(odd, VOCABULARY).collect()
    _same_rows(result, odd_rows)
    expected = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in odd_rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in result) == expected
    assert tokens.count_tokens(none, VOCABULARY).count() == 0


_DEFINITION = open(VOCABULARY, encoding="utf-8").read()
_COUNT = tokens.Counter(_DEFINITION, tokens.single_tokens(_DEFINITION))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aA'sStlLéÉ1٣ \n\x1c\x85\xa0́İΣς<|>endoftext🎉中‍.", max_size=40)))
def test_any_text_counts_as_in_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert _COUNT(text) == len(_COUNT.tokenizer.encode(text, add_special_tokens=False).ids)
