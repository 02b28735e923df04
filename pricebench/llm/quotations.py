"""Conversations in order of reply, without the text they quote.

Quoted lines are parsed into passages by their level of nesting.  Passages are
split at blank lines like what is said, normalised (line breaks of re-wrapped
quotes disappear) and hashed sentence by sentence; the first message of the conversation that says a sentence itself is
its original.  A message answers the original of its outermost quotes; without
any, the message before it.  A message that answers something older than the
message before it leaves the thread, unless it is the first to answer the end of
another thread, which it then resumes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricebench.llm.common import cut_lineage, text_batches
from pricebench.llm.components import components

_QUOTE = re.compile(r"\s{0,3}((?:>\s?)+)(.*)", re.S)
_ATTRIBUTION = re.compile(r"(wrote|said|writes|schrieb|a écrit|escribió)\s*:\s*$", re.I)
_BLANK = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Turns of one slice; a long conversation is worked on in many tasks.
SLICE = 1024


def passages(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages with their levels (1: quoted once)."""
    own: list[str] = []
    quoted: list[tuple[int, list[str]]] = []
    level_before = 0
    for line in (text or "").split("\n"):
        m = _QUOTE.fullmatch(line)
        level, body = (m[1].count(">"), m[2]) if m else (0, line)
        if not level:
            own.append(line)
        elif quoted and level == level_before:
            quoted[-1][1].append(body)
        else:
            while own and not level_before and (not own[-1].strip() or _ATTRIBUTION.search(own[-1])):
                own.pop()  # "... wrote:" and blank lines before a quote
            quoted.append((level, [body]))
        level_before = level
    found = [(n, "\n".join(lines)) for n, lines in quoted]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip(), [(n, t) for n, t in found if t.strip()]


def sentences(passage: str) -> list[int]:
    """Hashes of the normalised sentences of a passage; none goes over a blank line."""
    normal = [" ".join(part.lower().split()) for part in _BLANK.split(passage)]
    return [xxhash.xxh3_64_intdigest(s) - (1 << 63) for part in normal for s in _SENTENCE.split(part) if s]


def _parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            own, quoted = passages(t)
            said = sorted(set(sentences(own)))
            cited = [(level, h) for level, p in quoted for h in sentences(p)]
            rows.append((own, said, [x[0] for x in cited], [x[1] for x in cited], len(quoted)))
        yield pd.DataFrame(rows, columns=["own", "said", "levels", "cited", "n_quotes"])


def parse(messages: DataFrame) -> DataFrame:
    """Messages with their own text, hashes of what they say and cite; stored."""
    parsed = F.pandas_udf(_parse, "own string, said array<long>, levels array<int>, cited array<long>, n_quotes int")
    return cut_lineage(text_batches(messages).select("conv_id", "turn", "role", parsed("text").alias("p")).select("conv_id", "turn", "role", "p.*"))


def originals(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, level, original, n_sentences): what each level of quotes goes back to.

    Of several originals the one with most sentences counts, then the later one.
    """
    said = parsed.select("conv_id", "turn", F.explode("said").alias("hash"))
    first = cut_lineage(said.groupBy("conv_id", "hash").agg(F.min("turn").alias("original")))
    cited = parsed.select("conv_id", "turn", F.explode(F.arrays_zip("levels", "cited")).alias("c")).select(
        "conv_id", "turn", F.col("c.levels").alias("level"), F.col("c.cited").alias("hash")).distinct()
    found = cited.join(first, ["conv_id", "hash"]).where(F.col("original") < F.col("turn"))
    counted = found.groupBy("conv_id", "turn", "level", "original").agg(F.count("*").alias("n_sentences"))
    order = Window.partitionBy("conv_id", "turn", "level").orderBy(F.desc("n_sentences"), F.desc("original"))
    return counted.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def _carried(df: DataFrame, keys: list[str], value: str, out: str, strictly: bool) -> DataFrame:
    """The largest ``value`` of the turns up to each one (or strictly before it) within its keys, slice by slice.

    ``df`` has a column ``slice`` that grows with ``turn``.
    """
    order = Window.partitionBy(*keys, "slice").orderBy("turn")
    here = order.rangeBetween(Window.unboundedPreceding, -1 if strictly else Window.currentRow)
    of_slice = df.groupBy(*keys, "slice").agg(F.max(value).alias("__most"))
    before = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = of_slice.select(*keys, "slice", F.max("__most").over(before).alias("__carry"))
    return df.withColumn("__here", F.max(value).over(here)).join(carried, [*keys, "slice"]).withColumn(
        out, F.greatest("__here", "__carry")).drop("__here", "__carry")


def thread(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, reply_to, thread, position, n_quotes, text, formatted.

    ``thread`` is the turn that opens the thread, ``position`` counts its messages
    from 1 in order of reply, ``text`` is without quotes and ``formatted`` carries
    the role marks of a chat.  A null or empty text gives an empty one; a message
    of quotes only keeps its place with an empty text.  Messages with equal
    conv_id and turn are told apart by role and text only where they are ordered,
    and repeated rows repeat.  Rows with null conv_id or turn stand alone:
    thread, reply_to and position are null.  A null role is written as unknown.
    No rows give no rows; other columns are not read.
    """
    parsed = parse(messages)
    turns = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    answers = originals(parsed)
    outer = Window.partitionBy("conv_id", "turn").orderBy("level")
    answers = answers.withColumn("__p", F.row_number().over(outer)).where("__p = 1").select("conv_id", "turn", "original")
    turns = cut_lineage(turns.join(answers, ["conv_id", "turn"], "left").withColumn("slice", F.floor(F.col("turn") / SLICE)))
    turns = _carried(turns, ["conv_id"], "turn", "previous", strictly=True)
    turns = turns.withColumn("opens", F.when(F.col("previous").isNull() | (F.col("original") < F.col("previous")), F.col("turn")))
    turns = cut_lineage(turns)
    turns = cut_lineage(_carried(turns, ["conv_id"], "opens", "segment", strictly=False))

    # Segments that go on where another one ends.
    ends = turns.groupBy("conv_id", "segment").agg(F.max("turn").alias("end"))
    opened = turns.where("opens IS NOT NULL AND original IS NOT NULL").select("conv_id", F.col("segment").alias("later"), F.col("original").alias("end"))
    resumed = opened.join(ends, ["conv_id", "end"]).groupBy("conv_id", "segment").agg(F.min("later").alias("later"))
    resumed = cut_lineage(resumed.select("conv_id", "segment", "later", F.xxhash64("conv_id", "segment").alias("a"), F.xxhash64("conv_id", "later").alias("b")))
    if resumed.limit(1).count():
        root = components(resumed.select("a", "b"))
        named = resumed.select("conv_id", "segment", F.col("a").alias("node")).union(resumed.select("conv_id", "later", "b")).distinct().join(root, "node")
        opening = named.groupBy("root").agg(F.min("segment").alias("thread"))
        named = named.join(opening, "root").select("conv_id", "segment", "thread")
        turns = turns.join(named, ["conv_id", "segment"], "left").withColumn("thread", F.coalesce("thread", "segment"))
    else:
        turns = turns.withColumn("thread", F.col("segment"))
    reply = F.coalesce("original", "previous")
    placed = cut_lineage(turns.select("conv_id", "turn", "slice", "thread", reply.alias("reply_to")))

    rows = parsed.drop("said", "levels", "cited").join(placed, ["conv_id", "turn"], "left")
    before = Window.partitionBy("conv_id", "thread").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.join(parsed.groupBy("conv_id", "turn").count(), ["conv_id", "turn"]).groupBy("conv_id", "thread", "slice").agg(F.sum("count").alias("n"))
    base = sizes.select("conv_id", "thread", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("conv_id", "thread", "slice").orderBy("turn", "role", "own")
    rows = rows.withColumn("__row", F.row_number().over(inside)).join(base, ["conv_id", "thread", "slice"], "left")
    mark = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.col("own"))
    return rows.select(
        "conv_id", "turn", "role", "reply_to", "thread", (F.col("base") + F.col("__row")).alias("position"), F.col("n_quotes").cast("long").alias("n_quotes"),
        F.col("own").alias("text"), mark.alias("formatted"))


def op7_quotations(spark: SparkSession, folder: str) -> DataFrame:
    return thread(spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text"))
