import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"

#: Names that operators use for their results.
CLASHES = [
    "n_words", "kept", "cleaned", "loss", "n_lines", "kept_text", "shard", "slot", "size", "copies", "taken",
    "target", "source_size", "n_tokens", "component_id", "low", "high", "id", "n", "hub", "base", "window", "part",
]


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, ties, few words, odd characters."""
    sentence = "The quick brown fox jumps over the lazy dog near the old stone bridge."
    long = " ".join(f"word{i}" for i in range(60_000)) + "."
    return [
        (1, sentence, "a"), (1, sentence, "a"), (2, sentence, None), (3, None, "a"), (4, "", "b"), (5, " \n\t\n ", None),
        (6, long, "a"), (7, long + " tail", "b"), (None, sentence, "c"), (None, None, None), (8, "one two", "c"),
        (9, "ONE  two", "é"), (10, "x" * 50_000, "b"), (11, "\x00\x1c\x85 ́ 🎉 <|endoftext|>", "b"),
        (12, "same line of text\nsame line of text\n  SAME line of text ", "a"), (13, "same line of text", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    rows = [(*r, *[f"x{i}" for i in range(len(CLASHES))]) for r in odd_rows]
    names = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, source string, {names}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
