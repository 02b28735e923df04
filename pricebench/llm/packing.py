"""Packing documents into training windows with a controlled mixture of sources.

Every source is a queue of documents.  In each window a source earns its share
of the window as deficit and is served round-robin while its deficit covers a
quantum (or the rest of the document at hand); what it could not use it carries
to the next window.  Documents may be cut, so every window is full.

The work is split into lanes.  A document's place on its source's queue divided
by the source's share is its virtual time: the moment at which a fluid schedule
would start it.  A lane is a span of virtual time; queues are cut at its borders,
at whole quanta, also inside documents.  So it holds all sources in the target
proportion, and what a source owes or is owed at the start of a lane follows from
the place of its first token there.  That carries the
deficits from lane to lane without running the lanes one after the other.

The end of a lane goes into sequences of powers of two, so nothing is padded.
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricebench.llm.byte_bpe import TIKTOKEN_FILE, Encoder, Pieces, load_ranks
from pricebench.llm.common import cut_lineage, released, text_batches
from pricebench.llm.letter_classes import Classes, of_tiktoken, of_tokenizers
from pricebench.llm.perfect_hash import PerfectHash

WINDOW, QUANTUM, LANE_TOKENS = 2048, 256, 1 << 20
END_OF_DOCUMENT = 1
SPECIALS = {"<|endoftext|>": 50256}
#: Rows up to which the queue places of (source, input partition) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Length of a pre-token from which the heap merges faster than the library.
_LONG = 400
_LONG_SPACE = re.compile(rf"\s{{{_LONG}}}").search


@functools.lru_cache(maxsize=2)
def _by_heap(path: str) -> Pieces:
    ranks = load_ranks(path)
    return Pieces(ranks, PerfectHash(ranks))


class _LibraryPieces(Pieces):
    """Pre-tokens are looked up and merged by the library, very long ones by the heap."""

    most = 30_000

    def __init__(self, path: str):
        self.path, self.older = path, {}
        self.library = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})

    def ids_of(self, piece: bytes) -> list[int]:
        if len(piece) < _LONG:
            return self.library._encode_single_piece(piece)
        return _by_heap(self.path).ids_of(piece)


class _WholeTexts(Encoder):
    """Gives whole texts to the library, where it cuts pre-tokens alike and none of them is very long."""

    def encode(self, text: str | None) -> bytes:
        if not text or any(s in text for s in self.specials) or max(map(len, text.split()), default=0) >= _LONG or _LONG_SPACE(text):
            return super().encode(text)
        return np.array(self.pieces.library.encode_ordinary(text), "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def _encoder(path: str, classes: Classes | None = None, alike: bool | None = None) -> Encoder:
    """Cuts pre-tokens where the tokenizers library does; ``alike``: so does the tiktoken library."""
    classes = classes or of_tokenizers()
    kind = _WholeTexts if (classes == of_tiktoken() if alike is None else alike) else Encoder
    return kind(path, public_tokenizers.PATTERN, SPECIALS, _LibraryPieces(path), classes)


def _queued(path: str):
    """Encodes a partition's documents and notes each one's place among those of its source in this partition."""
    classes = of_tokenizers()
    alike = classes == of_tiktoken()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part, place = _encoder(path, classes, alike), TaskContext.get().partitionId(), defaultdict(int)
        for docs in batches:
            ids, places = [], []
            for text, source in zip(docs["text"], docs["source"]):
                i = np.frombuffer(enc.encode(text), "<u4").astype("<u2").tobytes() + END_OF_DOCUMENT.to_bytes(2, "little")
                ids.append(i)
                places.append(place[source])
                place[source] += len(i) // 2
            yield pd.DataFrame({"doc_id": docs["doc_id"], "source": docs["source"], "part": part, "place": places,
                                "n": [len(i) // 2 for i in ids], "ids": ids})

    return released(run)


def pack_lane(docs: list[tuple], shares: dict, start: float, window: int, quantum: int) -> Iterator[tuple]:
    """Pieces (document, start, length, sequence, offset) of one lane.

    ``docs``: (document or part of one, source, place on its queue, length), ordered
    by place within a source.  ``start``: the virtual time at which the lane begins.
    """
    queues: dict = defaultdict(deque)
    for doc, source, place, n in docs:
        queues[source].append((doc, n))
    deficit = {}
    for _, source, place, _ in docs:
        deficit.setdefault(source, shares[source] * start - place)
    left = sum(n for *_, n in docs)
    turn, at, sequence = deque(queues), dict.fromkeys(queues, 0), 0
    while left:
        size = min(window, 1 << left.bit_length() - 1)
        total = sum(shares[s] for s in turn)
        for s in turn:
            deficit[s] += size * shares[s] / total
        offset, passed = 0, 0
        while offset < size:
            # Once nobody's deficit covers a quantum, the one that is owed most goes ahead of its time.
            if passed == len(turn):
                turn.rotate(-max(range(len(turn)), key=lambda i: deficit[turn[i]]))
            s = turn[0]
            doc, n = queues[s][0]
            rest = n - at[s]
            if deficit[s] < min(quantum, rest) and passed < len(turn):
                turn.rotate(-1)
                passed += 1
                continue
            take = min(rest, size - offset, max(quantum, int(deficit[s])))
            yield doc, at[s], take, sequence, offset
            offset += take
            deficit[s] -= take
            at[s] += take
            passed = 0
            if at[s] == n:
                at[s] = 0
                queues[s].popleft()
                if not queues[s]:
                    turn.popleft()
        left -= size
        sequence += 1


def pack(docs: DataFrame, weights: dict[str, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM,
         lane_tokens: int = LANE_TOKENS, path: str | None = None) -> DataFrame:
    """Packs the whole texts of ``docs`` (doc_id, source, text) into sequences.

    ``weights`` gives the wanted share of tokens of each source; without it, or
    for sources it does not name, a source's part of all tokens is its share, so
    that all queues end together.  Returns one row per piece: doc_id, source,
    start, length, ids (packed, 32 bits each), doc_tokens, sequence_id, offset.

    A null or empty text is the end mark alone.  A null source is a queue of its
    own; null and repeated doc_ids and repeated rows are packed like any others.
    An empty table gives no pieces.  Other columns are not read.
    """
    path = path or public_tokenizers.path(TIKTOKEN_FILE)
    queued = text_batches(docs).select("doc_id", "source", "text").mapInPandas(
        _queued(path), "doc_id long, source string, part int, place long, n int, ids binary")
    queued = cut_lineage(queued)  # encoded once; everything after works on this table

    totals = queued.groupBy("source", "part").agg(F.sum("n").alias("total"))
    totals = cut_lineage(totals)
    n_rows = totals.count()
    base = _bases(totals, weights)
    if n_rows <= BROADCAST_ROWS:
        base = F.broadcast(base)
    q = queued.alias("q").join(
        base.alias("b"), F.col("q.source").eqNullSafe(F.col("b.source")) & (F.col("q.part") == F.col("b.part")))
    place = F.col("q.place") + F.col("b.base")
    laned = _in_lanes(q.select("q.doc_id", "q.source", place.alias("place"), "q.n", "q.ids", "b.share"), quantum, lane_tokens)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lane = int(key[0])
        rows = rows.sort_values(["place", "doc_id"], kind="stable").reset_index(drop=True)
        source = rows["source"].where(rows["source"].notna(), None)
        shares = dict(zip(source, rows["share"]))
        pieces = list(pack_lane(list(zip(rows.index, source, rows["place"], rows["part_n"].tolist())), shares, float(lane) * lane_tokens, window, quantum))
        tokens = [np.frombuffer(i, "<u2").astype("<u4") for i in rows["ids"]]
        doc = rows.loc[[p[0] for p in pieces]].reset_index(drop=True)
        return pd.DataFrame({
            "doc_id": doc["doc_id"], "source": doc["source"], "start": doc["skipped"] + [p[1] for p in pieces], "length": [p[2] for p in pieces],
            "ids": [tokens[d][a : a + n].tobytes() for d, a, n, *_ in pieces], "doc_tokens": doc["n"],
            "sequence_id": [lane << 32 | p[3] for p in pieces], "offset": [p[4] for p in pieces],
        })

    return laned.groupBy("lane").applyInPandas(
        run, "doc_id long, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def _in_lanes(docs: DataFrame, quantum: int, lane_tokens: int) -> DataFrame:
    """Parts of documents by lane: ``place`` and ``ids`` of the part, its length ``part_n``, and the tokens ``skipped`` before it.

    A quantum of a queue belongs to the lane in which it starts.  Sources that earn
    less than a quantum in a lane are cut by quanta, so that their lanes needn't be
    listed; the others by lanes.
    """
    of_lane = F.col("share") * lane_tokens  # tokens
    lane_of = lambda k: F.floor(k * quantum / of_lane).cast("long")
    first, last = F.floor(F.col("place") / quantum), F.floor((F.col("place") + F.col("n") - 1) / quantum)
    cut = F.col("by_quanta")
    border = lambda x: F.when(cut, x * quantum).otherwise(F.ceil(x * of_lane / quantum) * quantum)
    # One lane more on each side: what rounding leaves empty goes out below.
    docs = docs.withColumn("by_quanta", of_lane < quantum)
    steps = F.when(cut, F.sequence(first, last)).otherwise(F.sequence(F.greatest(lane_of(first) - 1, F.lit(0).cast("long")), lane_of(last) + 1))
    parts = docs.withColumn("step", F.explode(steps))
    parts = parts.withColumns({"low": F.greatest("place", border(F.col("step"))), "high": F.least(F.col("place") + F.col("n"), border(F.col("step") + 1))})
    skipped, part_n = F.col("low") - F.col("place"), F.col("high") - F.col("low")
    return parts.where("low < high").select(
        "doc_id", "source", F.col("low").alias("place"), "n", skipped.alias("skipped"), part_n.alias("part_n"), "share",
        F.substring("ids", (skipped * 2 + 1).cast("int"), (part_n * 2).cast("int")).alias("ids"),
        F.when(cut, lane_of(F.col("step"))).otherwise(F.col("step")).alias("lane"))


def _bases(totals: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Where the documents of (source, part) begin on their source's queue, and the source's share of all tokens."""
    from pyspark.sql import Window

    whole = totals.groupBy("source").agg(F.sum("total").alias("of_source"))
    size = F.col("of_source").cast("double")
    if weights:
        given = F.create_map(*[x for s, w in sorted(weights.items()) for x in (F.lit(s), F.lit(float(w)))])
        natural = whole.agg(F.sum("of_source")).first()[0] or 1
        size = F.coalesce(F.element_at(given, F.col("source")), size / natural)
    whole = whole.withColumn("size", size)
    everything = whole.agg(F.sum("size")).first()[0] or 1.0
    shares = whole.select(F.col("source").alias("__source"), (F.col("size") / everything).alias("share"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = totals.select("source", "part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return based.join(shares, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
