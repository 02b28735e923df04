"""Near-duplicate documents by min-max hashing.

Each permutation gives two values of a document's shingle set, its smallest and
its largest hash, so a signature takes half as many hash evaluations.  Values
are banded; documents that share a band are candidates.  With 40 bands of six
values (three permutations each) a pair of similarity 0.8 is missed with a
probability of 5 in a million.

Links are confirmed on full shingle sets, and no link that decides a component
is lost: candidates are first joined into candidate components through the
smallest member of each band, with no pairs listed; then each document's set
travels once to the task of its candidate component, where a search that only
looks at documents not yet reached finds the exact components.  Candidate
components too large for one task are cut into blocks: every block meets a fixed
number of hubs, and only the documents that the hubs leave outside the largest
class meet all blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pricebench.llm.common import BROADCAST_KEYS, cut_lineage, cut_sized, released, text_batches, with_key, without_keys
from pricebench.llm.components import components

SHINGLE, PERCENT = 5, 80
BANDS, PERMUTATIONS_PER_BAND = 40, 3
#: A candidate component of up to this many documents and shingles is settled in one task; larger ones go in blocks.
TASK_DOCS, TASK_SHINGLES = 1000, 1_000_000
HUBS = 32

_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 2**31, (BANDS * PERMUTATIONS_PER_BAND, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, (BANDS * PERMUTATIONS_PER_BAND, 1), dtype=np.uint32)
_BAND_FACTORS = _RNG.integers(1, 2**63, (BANDS, 2 * PERMUTATIONS_PER_BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_FACTORS = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COLUMNS = 4096  # shingles hashed at a time, so that very long texts take no more memory


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 60_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@functools.lru_cache(maxsize=1)
def _words() -> _Words:
    return _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles of the whole text."""
    words = text.encode().lower().split() if text else []  # A-Z only; splits at space and \\x09-\\x0D only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
    h = np.fromiter(map(_words().__getitem__, words), np.uint64, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out += h[i : n - k + 1 + i] * _WORD_FACTORS[i]
    return np.unique(_mixed(out))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of the min-max signature of a set that is not empty."""
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    low = high = None
    for i in range(0, len(x), _COLUMNS):
        h = _A * x[None, i : i + _COLUMNS] + _B
        lo, hi = h.min(1), h.max(1)
        low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
    values = np.stack([low, high], 1).reshape(BANDS, -1).astype(np.uint64)
    return _mixed((values * _BAND_FACTORS).sum(1, dtype=np.uint64)).view(np.int64)


def _signed(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs in batches:
            rows = []
            for doc, text in zip(docs["doc_id"], docs["text"]):
                s = shingle_set(text, k)
                if len(s):
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    rows.append((doc, len(s), (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63), band_keys(s)))
                else:
                    rows.append((doc, 0, None, None, None))
            out = pd.DataFrame(rows, columns=["doc_id", "n_shingles", "s1", "s2", "bands"])
            yield out.assign(doc_id=docs["doc_id"].values, s1=out["s1"].astype("Int64"), s2=out["s2"].astype("Int64"))

    return released(run)


def linked(a: int, b: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    return 100 * both >= percent * (a + b - both)


def search(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the index of the first set it is linked to, directly or through others."""
    k = len(sets)
    root = np.full(k, -1)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    number, codes = np.unique(flat, return_inverse=True)
    codes = codes.reshape(-1)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    marked = np.zeros(len(number), bool)
    rest, rest_codes, rest_starts = np.arange(k), codes, starts
    for first in range(k):
        if root[first] >= 0:
            continue
        reached = [first]
        root[first] = first
        while reached and len(rest):
            x = reached.pop()
            if (keep := root[rest] < 0).sum() < len(rest):  # leave out what has been reached since
                rest = rest[keep]
                if not len(rest):
                    break
                rest_codes = np.concatenate([codes[starts[i] : ends[i]] for i in rest])
                rest_starts = np.cumsum(sizes[rest]) - sizes[rest]
            mine = codes[starts[x] : ends[x]]
            marked[mine] = True
            both = np.add.reduceat(marked[rest_codes], rest_starts, dtype=np.int64)
            marked[mine] = False
            found = rest[linked(sizes[x], sizes[rest], both, percent)]
            root[found] = first
            reached.extend(found.tolist())
    return root


def _sets(rows: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in rows["shingles"]]


def _settle(percent: int):
    """Edges from each document of a bundle of groups to the first one it is linked with."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "doc_id"]).drop_duplicates(["part", "doc_id"])
        out = []
        for _, group in rows.groupby("part", sort=False):
            ids = group["doc_id"].to_numpy()
            root = search(_sets(group), percent)
            moved = root != np.arange(len(ids))
            out.append(pd.DataFrame({"a": ids[moved], "b": ids[root[moved]]}))
        return pd.concat(out)

    return run


def _cross(percent: int):
    """Edges between the outside documents of a block pair and documents of other classes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        outer, inner = rows[rows["outside"]], rows[~rows["outside"]]
        a, b = [], []
        if len(outer) and len(inner):
            sets = _sets(inner)
            sizes = np.array([len(s) for s in sets])
            number, codes = np.unique(np.concatenate(sets), return_inverse=True)
            codes, starts = codes.reshape(-1), np.cumsum(sizes) - sizes
            ids, classes = inner["doc_id"].to_numpy(), inner["class"].to_numpy()
            for doc, own, s in zip(outer["doc_id"], outer["class"], _sets(outer)):
                marked = np.isin(number, s, assume_unique=True)
                both = np.add.reduceat(marked[codes], starts, dtype=np.int64)
                hit = linked(len(s), sizes, both, percent) & (classes != own)
                # One edge to each class that is reached is enough.
                reached, at = np.unique(classes[hit], return_index=True)
                a += [doc] * len(reached)
                b += ids[hit][at].tolist()
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


def _with_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """``wanted`` (doc_id, ...) with the shingle sets, computed from the texts of these documents only."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.drop(columns="text").assign(shingles=[shingle_set(t, k).tobytes() for t in rows["text"]])

    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted
    joined = docs.join(side, docs["doc_id"] == side["__id"])
    # Of rows that share a doc_id, the one whose set was signed.
    columns = [c for c in wanted.columns if c != "__id"]
    schema = ", ".join(["doc_id long", *[f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema if f.name != "__id"], "shingles binary"])
    return joined.select("doc_id", *columns, "text").mapInPandas(released(run), schema)


def _exact(docs: DataFrame, candidates: DataFrame, k: int, percent: int) -> DataFrame:
    """(node, root) over the confirmed links among ``candidates`` (doc_id, n_shingles, comp)."""
    sizes = candidates.groupBy("comp").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("weight"))
    blocks = F.greatest(F.ceil(2 * F.col("docs") / TASK_DOCS), F.ceil(2 * F.col("weight") / TASK_SHINGLES))
    is_large = (F.col("docs") > TASK_DOCS) | (F.col("weight") > TASK_SHINGLES)
    n = candidates.count()
    sizes = cut_sized(sizes.withColumn("blocks", F.when(is_large, blocks).otherwise(0).cast("int")), n)
    weight = sizes.agg(F.sum("weight")).first()[0] or 0
    bundles = max(1, -(-weight // (TASK_SHINGLES // 2)))
    placed = cut_sized(candidates.join(sizes.select("comp", "blocks"), "comp").select(
        F.col("doc_id").alias("__id"), "comp", "blocks",
        F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("doc_id"), F.greatest("blocks", F.lit(1)))).otherwise(0).cast("int").alias("block")), n)

    small = _with_sets(docs, placed.where("blocks = 0").select("__id", F.col("comp").alias("part")), k)
    edges = small.groupBy(F.pmod(F.xxhash64("part"), F.lit(bundles)).alias("bundle")).applyInPandas(_settle(percent), "a long, b long")
    if not sizes.where("blocks > 0").count():
        return components(edges)

    large = cut_lineage(_with_sets(docs, placed.where("blocks > 0").select("__id", "comp", "blocks", "block"), k))
    first = Window.partitionBy("comp").orderBy(F.xxhash64("doc_id"), "doc_id")
    hubs = large.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= HUBS).drop("rank")
    met = large.union(hubs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(large.columns))
    by_hub = met.withColumn("part", F.lit(0).cast("long")).groupBy("comp", "block").applyInPandas(_settle(percent), "a long, b long")
    edges = cut_lineage(edges.union(by_hub))
    roots = cut_sized(components(edges), n)

    classed = large.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn("class", F.coalesce("root", "doc_id"))
    classed = cut_lineage(classed.drop("root"))
    count = classed.groupBy("comp", "class").count()
    main = count.groupBy("comp").agg(F.max(F.struct("count", "class")).alias("m")).select("comp", F.col("m.class").alias("main"))
    outside = classed.join(F.broadcast(main) if main.count() <= BROADCAST_KEYS else main, "comp").where(F.col("class") != F.col("main"))
    outside = outside.select("doc_id", "comp", "blocks", "class", "shingles", F.col("block").alias("outer_block"))
    outer = outside.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    needed = cut_sized(outside.select("comp", "outer_block").distinct(), n)
    inner = classed.select("doc_id", "comp", "blocks", "class", "shingles", "block").join(needed, "comp")
    columns = ["doc_id", "comp", "class", "shingles", "block", "outer_block"]
    pairs = outer.select(*columns, F.lit(True).alias("outside")).union(inner.select(*columns, F.lit(False).alias("outside")))
    crossed = pairs.groupBy("comp", "block", "outer_block").applyInPandas(_cross(percent), "a long, b long")
    return components(edges.union(crossed))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Two documents are linked if their sets of k-word shingles share at least
    ``percent`` of their union; component_id is the smallest doc_id reachable.
    A document of fewer than k words has its whole word sequence as one shingle;
    without words (or text) its set is empty and it is linked with nothing.
    Repeated rows repeat.  Rows that share a doc_id should share the text;
    otherwise each row is grouped by its own text.  Rows with null doc_id have no
    component and are kept.  An empty table gives no rows; other columns are
    not read.
    """
    docs = text_batches(docs).select("doc_id", "text")
    signed = cut_lineage(docs.mapInPandas(_signed(k), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"))
    named = signed.where(F.col("doc_id").isNotNull() & F.col("s1").isNotNull())
    # Copies have one set: its smallest doc_id stands for it.
    n = named.count()
    same = cut_sized(named.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), n)
    n_sets = same.count()
    members = named.select("doc_id", "s1", "s2", "n_shingles", "bands").join(
        same.select("s1", "s2", F.col("rep").alias("doc_id")), ["doc_id", "s1", "s2"], "left_semi")
    members = cut_sized(members.select("doc_id", "n_shingles", F.explode("bands").alias("key")).distinct(), n_sets * BANDS // 4)  # three longs a row
    hubs = cut_sized(members.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"), n_sets * BANDS // 8)
    near = members.join(hubs, "key").where(F.col("doc_id") != F.col("hub")).select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    loose = components(near)
    sizes = members.select("doc_id", "n_shingles").distinct()
    candidates = cut_sized(loose.select(F.col("node").alias("doc_id"), F.col("root").alias("comp")).join(sizes, "doc_id"), n_sets)
    exact = _exact(docs, candidates, k, percent)
    roots = same.join(exact.select(F.col("node").alias("rep"), "root"), "rep", "left").where((F.col("copies") > 1) | (F.col("root") < F.col("rep")))
    roots = cut_sized(roots.select("s1", "s2", F.coalesce("root", "rep").alias("root")), n_sets)
    component = F.coalesce("root", "doc_id")
    return signed.drop("bands").join(roots, ["s1", "s2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, columns unchanged; further rows with the kept doc_id go as well."""
    dropped = near_duplicates(docs, k, percent).where(~F.col("kept")).select("doc_id")
    dropped = cut_lineage(with_key(dropped.distinct(), "doc_id"))
    rest = without_keys(with_key(docs, "doc_id"), dropped, F.col("doc_id"))
    again = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1")
    if not again.limit(1).count():
        return rest.select(*docs.columns)
    order = Window.partitionBy("doc_id").orderBy(*[F.xxhash64("text"), "text"])
    return rest.withColumn("__place", F.row_number().over(order)).where(
        (F.col("__place") == 1) | F.col("doc_id").isNull()).select(*docs.columns)


def op8_minmax_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{folder}/documents.parquet"), k=4)


#: All pairs with a common shingle, confirmed and followed; for small tables.
ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) g FROM d),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1),
p AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id node, doc_id low FROM d UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node AND r.low < u.b),
m AS (SELECT node, min(low) low FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0)::BIGINT n_shingles, low component_id, doc_id = low kept FROM d JOIN m ON m.node = doc_id LEFT JOIN n USING (doc_id)
"""
