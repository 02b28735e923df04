"""Divergence of word use between the sources of a language.

Texts are lowered, split, dictionary-encoded and counted by Arrow kernels inside
mapInArrow, so that only partial counts of a batch leave a task.  Spark merges
them.  The merged counts of a language are dealt into shards by term; each shard
is a small table of terms by sources whose columns are compared with each other,
and the partial differences of the shards are added up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from pricebench.llm.common import cut_lineage, released, text_batches

#: A term counts if it is in at least so many documents of its language.
LEAST_DOCS = 30
#: Share units (parts in a thousand million) and the count that is added to each term.
UNITS, ADDED = 1_000_000_000, 5
#: Terms listed for each source.
TERMS = 50
#: Cells (terms times sources) of one shard.
SHARD_CELLS = 200_000
#: Everything but letters: ASCII outside A-Z and a-z.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SLICE_BYTES = 4 << 20
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a few megabytes of text; a longer text goes alone."""
    ends = np.cumsum(pc.binary_length(batch["text"]).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + _SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def partial_counts(batch: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of the rows of a batch; a row without term for each (lang, source)."""
    langs, sources = batch["lang"].dictionary_encode(), batch["source"].dictionary_encode()
    width = max(1, len(sources.dictionary))
    group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
    parts = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), pattern=BETWEEN)
    words, row = pc.list_flatten(parts), pc.list_parent_indices(parts)
    filled = pc.not_equal(words, "")
    words, row = words.filter(filled).dictionary_encode(), row.filter(filled).to_numpy()
    found = pa.table({"group": group[row], "row": row, "code": words.indices})
    by_row = found.group_by(["group", "row", "code"]).aggregate([([], "count_all")])
    counts = by_row.group_by(["group", "code"]).aggregate([("count_all", "sum"), ("count_all", "count")])
    seen = np.unique(group)
    groups = pa.chunked_array([*counts["group"].chunks, pa.array(seen)], pa.int64()).to_numpy()
    terms = words.dictionary.take(counts["code"].combine_chunks())
    zeros = pa.array(np.zeros(len(seen), np.int64))
    return pa.table([
        langs.dictionary.take(pa.array(groups // width)), sources.dictionary.take(pa.array(groups % width)),
        pa.chunked_array([terms, pa.nulls(len(seen), pa.string())]),
        pa.chunked_array([*counts["count_all_sum"].chunks, zeros], pa.int64()), pa.chunked_array([*counts["count_all_count"].chunks, zeros], pa.int64()),
    ], schema=_PARTIAL)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch):
            yield from partial_counts(part).to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, and a row without term for each (lang, source)."""
    texts = text_batches(docs).select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = texts.mapInArrow(released(_counted), "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (n + ADDED) / (total + ADDED * terms)), exactly."""
    # The whole-number quotient of decimals can't overflow at any count a long holds.
    above = F.lit(UNITS).cast("decimal(10,0)") * (n + ADDED).cast("decimal(19,0)")
    return F.call_function("div", above, (total + ADDED * terms).cast("decimal(19,0)")) + 1


def _compared(table: pa.Table) -> pa.Table:
    """Sums over the terms of a shard of the differences between each two of its sources, the lesser name first.

    Rows without term list all sources of the language with the share of a term that they lack.
    """
    frame = table.to_pandas()
    listed = frame[frame["term"].isna()].sort_values("source")
    sources = {s: i for i, s in enumerate(listed["source"])}
    frame = frame[frame["term"].notna()]
    terms, numbers = pd.factorize(frame["term"])
    shares = np.tile(listed["p"].to_numpy(np.int64)[:, None], (1, len(numbers)))
    shares[frame["source"].map(sources).to_numpy(np.int64), terms] = frame["p"].to_numpy(np.int64)
    names = list(sources)
    a, b, f = [], [], []
    for i in range(len(names) - 1):
        a += [names[i]] * (len(names) - 1 - i)
        b += names[i + 1 :]
        f.append(np.abs(shares[i + 1 :] - shares[i]).sum(1))
    lang = frame["lang"].iloc[0] if len(frame) else listed["lang"].iloc[0]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()),
                     "value": pa.array(np.concatenate(f) if f else [], pa.int64())})


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """How the sources of each language differ: lang, source, part, item, value, rank.

    Part ``pair``: item is another source of the language, value the difference of
    their shares summed over all kept terms.  Part ``term``: item is a kept term of
    the source whose share is above the language's, value the excess; the first
    ``terms`` of them.  Shares are whole parts in a thousand million with five
    added to each count.  Ranks go by falling value, then by item in UTF-8 order.

    Null lang, source and text are read as empty.  Each row counts as a document,
    repeated ones too; doc_id is not read.  A language whose terms are all too
    rare has pairs of value 0; a source alone in its language has none.  An empty
    table gives no rows; other columns are not read.
    """
    counts = cut_lineage(term_counts(docs))
    kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least_docs)
    found = cut_lineage(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept.select("lang", "term", "all_n"), ["lang", "term"]))
    groups = counts.where("term IS NULL").select("lang", "source")
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(
        found.select("lang", "term", "all_n").distinct().groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n")), "lang", "left").select(
        "lang", "n_sources", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"))
    groups = groups.join(found.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(of_lang, "lang")
    groups = cut_lineage(groups.withColumn("group_n", F.coalesce("group_n", F.lit(0))))
    p = _share(F.col("n"), F.col("group_n"), F.col("v"))
    shares = found.join(groups, ["lang", "source"]).withColumns({"p": p, "q": _share(F.col("all_n"), F.col("lang_n"), F.col("v"))})
    shares = cut_lineage(shares.select("lang", "source", "term", "p", "q"))

    cells = groups.groupBy("lang").agg((F.first("v") * F.first("n_sources")).alias("cells")).agg(F.max("cells")).first()[0] or 0
    shards = F.lit(int(-(-cells // SHARD_CELLS) or 1))
    lacking = F.when(F.col("v") > 0, _share(F.lit(0), F.col("group_n"), F.greatest("v", F.lit(1)))).otherwise(0)
    listed = groups.select("lang", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"), "source", F.lit(None).cast("string").alias("term"), lacking.alias("p"))
    dealt = shares.select("lang", F.pmod(F.xxhash64("term"), shards).cast("int").alias("shard"), "source", "term", "p").union(listed)
    compared = dealt.groupBy("lang", "shard").applyInArrow(_compared, "lang string, a string, b string, value long")
    half = cut_lineage(compared.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    pairs = half.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value").union(
        half.select("lang", "b", F.lit("pair"), "a", "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.withColumn("rank", F.row_number().over(order)).union(
        above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{folder}/documents.parquet").select("lang", "source", "text"))


ORACLE = """
WITH d AS (SELECT row_number() OVER () r, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w FROM documents),
t AS (SELECT r, lang, source, unnest(w) term FROM d),
k AS (SELECT lang, term, count(*) all_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
l AS (SELECT d.lang, coalesce(any_value(x.v), 0) v, coalesce(any_value(x.n), 0) lang_n FROM d LEFT JOIN (SELECT lang, count(*) v, sum(all_n)::HUGEINT n FROM k GROUP BY 1) x USING (lang) GROUP BY 1),
c AS (SELECT t.lang, t.source, t.term, count(*) n FROM t JOIN k ON k.lang = t.lang AND k.term = t.term GROUP BY 1, 2, 3),
g AS (SELECT s.lang, s.source, coalesce(sum(c.n), 0)::HUGEINT group_n FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN c ON c.lang = s.lang AND c.source = s.source GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (group_n + 5 * v) p, 1 + (1000000000::HUGEINT * (all_n + 5)) // (lang_n + 5 * v) q
  FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pr AS (SELECT a.lang, a.source, b.source item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
pv AS (SELECT x.lang, x.source, y.source item, sum(abs(x.p - y.p)) value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
r AS (SELECT pr.lang, pr.source, 'pair' part, pr.item, coalesce(value, 0)::BIGINT value FROM pr LEFT JOIN pv ON pv.lang = pr.lang AND pv.source = pr.source AND pv.item = pr.item
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50
"""
