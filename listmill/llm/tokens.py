"""Token counts with a whole-token shortcut (operator 9).

Before any text is read, the driver proves which vocabulary entries come out as one token
when they are encoded alone. A text is cut into pre-tokens; each that is proven counts as
one, and only the rest goes through the merges.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listmill.llm.common import documents, ship_with_jobs, text_of

ship_with_jobs(__name__)

LIMIT = 2048
#: A task remembers counts of so many different words of at most so many characters.
_MEMORY, _LONGEST = 300_000, 40
_BLANKS = re.compile(r"[\t-\r ]+")
#: Words of these characters are cut without the library: lower case changes them one by
#: one, composition does not change them, and their classes are the same in every Unicode.
_LATIN = "À-ÖØ-öø-ÿ"
_SIMPLE = re.compile(f"[!-~{_LATIN}]+")
#: The split pattern of the definition, for such words in lower case. Fixed value.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^0-9a-z{_LATIN}]+")


def _tokenizer(definition: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def single_tokens(definition: str) -> frozenset[str]:
    """Pre-tokens, in the form the model reads them, that are proven to be one token.

    Every vocabulary entry is given to the model by itself, without and with the suffix for
    word ends, and stays only if the model answers with one token.
    """
    tokenizer = _tokenizer(definition)
    suffix = tokenizer.model.end_of_word_suffix or ""
    heads = {v.removesuffix(suffix) if suffix else v for v in tokenizer.get_vocab(False)}
    return frozenset(v for v in heads if v and len(tokenizer.model.tokenize(v)) == 1)


def _splits(definition: str) -> list[str]:
    steps = json.loads(definition)["pre_tokenizer"] or {}
    steps = steps.get("pretokenizers", [steps])
    patterns = [s["pattern"].get("Regex") for s in steps if s.get("type") == "Split"]
    return patterns if all(s.get("type") == "Split" or not s.get("use_regex", True) for s in steps) else []


def _lower_case(definition: str) -> bool:
    steps = json.loads(definition)["normalizer"] or {}
    kinds = [s.get("type") for s in steps.get("normalizers", [steps])]
    return set(kinds) <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds


class Counter:
    """Counts tokens of texts as the library does, one word at a time."""

    def __init__(self, definition: str, proven: frozenset[str]):
        self.tokenizer, self.proven, self.known = _tokenizer(definition), proven, {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        names = sorted((str(t.content) for t in added), key=len, reverse=True)
        self.simple = _SPLIT in _splits(definition) and _lower_case(definition)
        letters = [chr(i) for i in range(0xC0, 0x100)]
        self.bytes = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def word(self, word: str) -> int:
        if self.simple and _SIMPLE.fullmatch(word):
            pieces = [p if p.isascii() else p.translate(self.bytes) for p in _PIECES.findall(word.lower())]
        else:
            text = self.tokenizer.normalizer.normalize_str(word) if self.tokenizer.normalizer else word
            pieces = [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        total = 0
        for piece in pieces:
            total += 1 if piece in self.proven else len(self.tokenizer.model.tokenize(piece))
        if len(word) <= _LONGEST:
            if len(self.known) >= _MEMORY:
                self.known.clear()
            self.known[word] = total
        return total

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        for word in _BLANKS.split(text):
            n = known.get(word)
            total += self.word(word) if n is None else n
        return total

    def __call__(self, text: str) -> int:
        if self.special is None:
            return self.plain(text)
        total, end = 0, 0
        for m in self.special.finditer(text):
            total, end = total + 1 + self.plain(text[end:m.start()]), m.end()
        return total + self.plain(text[end:] if end else text)


def count_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for each row.

    ``vocabulary`` is the path, on the driver, of a file of the tokenizers library whose
    normalizer and pre-tokenizer look at no more than one blank-separated word at a time.
    Counts are the library's, without begin and end tokens; special strings in a text are
    one token each. A null text is empty and has no token; a null id stays null; every row
    is counted by itself, so repeated rows get equal counts; an empty table gives none.

    One scan without an exchange. The definition and the proven entries (their size is the
    vocabulary's) are sent once per executor. A task keeps a bounded memory of words.
    """
    with open(vocabulary, encoding="utf-8") as f:
        definition = f.read()
    # The value outlives a task in its worker, and so does what tasks put into ``state``.
    shared = docs.sparkSession.sparkContext.broadcast(
        {"definition": definition, "proven": single_tokens(definition), "state": {}})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value["state"]
        if "counter" not in state:
            state["counter"] = Counter(shared.value["definition"], shared.value["proven"])
        count = state["counter"]
        for batch in batches:
            numbers = pa.array([count(x.as_py()) for x in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), numbers], ["_lm_id", "_lm_b", "_lm_n"])

    text = text_of(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_lm_id"), text.alias("_lm_t"), F.octet_length(text).cast("long").alias("_lm_b"))
    result = rows.mapInArrow(counted, f"_lm_id {kind}, _lm_b bigint, _lm_n bigint")
    return result.select(
        F.col("_lm_id").alias(id_col), F.col("_lm_b").alias("n_bytes"), F.col("_lm_n").alias("n_tokens"),
        (F.col("_lm_n") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
