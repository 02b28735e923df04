"""Token counts without tokenizing: most pre-tokens are known to be one token.

Before the job, every vocabulary string that can end a word is merged on its
own; those that come out as one token are proven whole.  A pre-token's tokens
depend on nothing outside it, so a proven string counts one wherever it occurs.
Only the remaining pre-tokens are merged, and what a worker has counted it keeps
in a bounded table.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from pricebench.llm.common import text_batches
from pricebench.llm.letter_classes import Classes, Lowering, lowering, of_tokenizers, splitter
from pricebench.llm.merging import merge, pack_pair

WORD_FILE = "word_bpe_49k.json"
REMEMBERED, REMEMBERED_CHARS = 200_000, 48


@functools.lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code point from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """The parts of a tokenizer file that decide how many tokens a text has."""

    def __init__(self, path: str, classes: Classes | None = None, normal: Lowering | None = None):
        self.normal = normal or lowering()
        with open(path, encoding="utf8") as f:
            self.spec = json.load(f)
        model = self.spec["model"]
        self.suffix = model["end_of_word_suffix"]
        letters = byte_letters()
        base = letters + [c + self.suffix for c in letters]
        number = {s: i for i, s in enumerate(base)}
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            if number.setdefault(a + b, 256 * 2 + rank) != 256 * 2 + rank:
                raise ValueError(f"two merges make {a + b!r}")
            self.pairs[pack_pair(number[a], number[b])] = 512 + rank
        self.words = [s for s in model["vocab"] if s.endswith(self.suffix)]
        steps = self.spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a tokenizer file of another kind")
        self.split = splitter(self.spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], classes or of_tokenizers())
        specials = [t["content"] for t in self.spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True))))

    def count_word(self, word: bytes) -> int:
        parts = list(word)
        parts[-1] += 256  # the last byte carries the end of the word
        return len(merge(parts, self.pairs))

    def proven(self) -> dict[str, int]:
        """Words that are one token, as text.  Bounded by the vocabulary."""
        back = {c: b for b, c in enumerate(byte_letters())}
        out = {}
        for s in self.words:
            raw = bytes(back[c] for c in s[: -len(self.suffix)])
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue  # part of a character: never a whole pre-token
            if self.count_word(raw) == 1:
                out[text] = 1
        return out


class Counts(dict):
    def __init__(self, bpe: WordBpe, proven: dict[str, int]):
        super().__init__(proven)
        self.bpe, self.proven, self.older = bpe, proven, {}

    def __missing__(self, word: str) -> int:
        n = self.older.get(word) or self.bpe.count_word(word.encode())
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED + len(self.proven):
                self.older = dict(self)
                self.clear()
                self.update(self.proven)
            self[word] = n
        return n

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        bpe = self.bpe
        parts, specials = (bpe.cut.split(text), bpe.cut.findall(text)) if "<|" in text else ([text], ())
        return len(specials) + sum(sum(map(self.__getitem__, bpe.split(bpe.normal(p)))) for p in parts if p)


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@functools.lru_cache(maxsize=2)
def proven_words(path: str) -> dict[str, int]:
    return word_bpe(path).proven()


_counts: dict[str, Counts] = {}


def count_tokens(docs: DataFrame, text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each whole text.

    Null and empty texts have none.  Rows are independent: repeated rows repeat,
    an empty table stays empty, other columns pass through (one named like
    ``out`` is replaced).
    """
    path = path or public_tokenizers.path(WORD_FILE)
    # Proven words and what the library says of code points: found once, of bounded size.
    known = docs.sparkSession.sparkContext.broadcast((proven_words(path), of_tokenizers(), lowering()))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _counts:  # kept by the worker from task to task
            proven, classes, normal = known.value
            _counts[path] = Counts(WordBpe(path, classes, normal), proven)
        for texts in batches:
            yield pd.Series([_counts[path].of(t) for t in texts], dtype="int64")

    return text_batches(docs).withColumn(out, count(F.col(text)))


def op4_token_counts(spark, folder: str, limit: int = 2048) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
