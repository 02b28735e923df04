"""Byte-level BPE: encoding texts to packed ids and back.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that
are one token as a whole; only misses are merged, with a heap over linked bytes.
What a task has resolved it keeps in a bounded table, so a frequent pre-token is
looked up once per task.  Ids are packed as little-endian unsigned 32-bit
integers (``ids`` BINARY), the layout of token files for training.
"""

from __future__ import annotations

import base64
import functools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from pricebench.llm.common import text_batches
from pricebench.llm.letter_classes import Classes, of_tiktoken, splitter
from pricebench.llm.merging import merge, pair_table
from pricebench.llm.perfect_hash import PerfectHash

TIKTOKEN_FILE = "byte_bpe_50k.tiktoken"
#: Pre-tokens of one generation that a worker remembers, and the longest one it remembers.
REMEMBERED, REMEMBERED_CHARS = 150_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file; its size bounds every table built from it."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Pieces(dict):
    """Pre-token to packed ids; resolves what it has not met yet.

    What does not fit any more moves to an older generation, from which only
    what is used again comes back.
    """

    most = REMEMBERED

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash):
        super().__init__()
        self.whole, self.older = whole, {}
        self.pairs = pair_table(ranks)
        self.single = [ranks[bytes([i])] for i in range(256)]

    def ids_of(self, piece: bytes) -> list[int]:
        if (one := self.whole.get(piece)) is not None:
            return [one]
        return merge(list(map(self.single.__getitem__, piece)), self.pairs)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece) or self.pack(self.ids_of(piece.encode()))
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """``specials``: strings that are one id wherever they stand in a text."""

    def __init__(self, path: str, pattern: str, specials: dict[str, int] | None = None, pieces: Pieces | None = None, classes: Classes | None = None):
        if pieces is None:
            ranks = load_ranks(path)
            pieces = Pieces(ranks, PerfectHash(ranks))
        self.pieces = pieces
        self.split = splitter(pattern, classes or of_tiktoken())
        self.specials = {s: np.array([i], "<u4").tobytes() for s, i in (specials or {}).items()}
        # Of two that match at one place the longer one counts.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if specials else None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        get = self.pieces.__getitem__
        if self.cut is None:
            return b"".join(map(get, self.split(text)))
        out = []
        for part in self.cut.split(text):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                out.extend(map(get, self.split(part)))
        return b"".join(out)


@functools.lru_cache(maxsize=4)
def encoder(path: str, pattern: str, specials: tuple[tuple[str, int], ...] = (), classes: Classes | None = None) -> Encoder:
    """Built once in each Python worker, from the installed vocabulary file."""
    return Encoder(path, pattern, dict(specials), classes=classes)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, specials: tuple[tuple[str, int], ...] = ()) -> list[bytes]:
    """The bytes of each id; decoding needs nothing else."""
    by_id = {i: b for b, i in load_ranks(path).items()} | {i: s.encode() for s, i in specials}
    return [by_id.get(i, b"") for i in range(max(by_id) + 1)]


def encode_udf(path: str, pattern: str, specials: dict[str, int] | None = None):
    fixed, classes = tuple(sorted((specials or {}).items())), of_tiktoken()

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern, fixed, classes)
        for texts in batches:
            yield pd.Series([enc.encode(t) for t in texts], dtype=object)

    return encode


def decode_udf(path: str, specials: dict[str, int] | None = None):
    fixed = tuple(sorted((specials or {}).items()))

    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bytes_of = vocabulary(path, fixed).__getitem__
        for packed in batches:
            yield pd.Series([b"".join(map(bytes_of, np.frombuffer(p, "<u4").tolist())) for p in packed], dtype=object)

    return decode


def encode_texts(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None,
                 specials: dict[str, int] | None = None) -> DataFrame:
    """``docs`` with the packed ids of each whole text.

    Null and empty texts give empty ids.  Every row is encoded by itself:
    repeated rows repeat, an empty table stays empty, further columns pass
    through; a column already named like ``ids`` is replaced.
    """
    path = path or public_tokenizers.path(TIKTOKEN_FILE)
    return text_batches(docs).withColumn(ids, encode_udf(path, pattern or public_tokenizers.PATTERN, specials)(F.col(text)))


def decode_ids(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None,
               specials: dict[str, int] | None = None) -> DataFrame:
    """``df`` with the bytes behind packed ids (not always valid UTF-8 when ids were cut)."""
    path = path or public_tokenizers.path(TIKTOKEN_FILE)
    return df.withColumn(out, decode_udf(path, specials)(F.coalesce(F.col(ids), F.lit(b""))))


def op3_byte_bpe(spark, folder: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    out = decode_ids(encode_texts(docs))
    return out.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
