"""Quality rules: base counts of a text, and lines that recur over many documents of a host.

Lines are normalised and hashed.  For each host the distinct documents that hold
a line are counted; lines above the limit are taken out of every document but
the one with the smallest doc_id that has them (``keep_good`` returns the texts
so cleaned), and a document that loses more than the allowed part of its words is
rejected.

Exact copies count as one document, so a group of copies doesn't make its own
lines look like page furniture.  Lines of every length count.  Of near copies
each line stays with its first holder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from pricebench.llm.common import SALTS, beside_keys, cut_lineage, released, text_batches, with_key

MAX_DOCS, MAX_LOST = 20, 0.5
_WINDOW = 8
_SYMBOLS = "#*$%&|<>"
#: One odd multiplier for each place of a window.
_FACTORS = np.random.default_rng(8).integers(1, 2**63, _WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside 8-word windows that occur at least twice, the first one included."""
    n = len(words) - _WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    keys = np.zeros(n, np.uint64)
    for k in range(_WINDOW):
        keys += ids[k : k + n] * _FACTORS[k]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    starts = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[starts + _WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """The five base counts of a text; a null text has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode()
    words = raw.split()  # bytes split at space and \\x09-\\x0D only
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    return len(words), len(text) - spaces, sum(map(text.count, _SYMBOLS)), dup, repeated_words(words)


def _line(line: str) -> tuple[int, int]:
    """Number of words of a line, and the hash of the line normalised (0 for a blank one)."""
    words = line.encode().lower().split() if line.isascii() else line.lower().encode().split()
    return len(words), xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63) if words else 0


def line_counts(text: str | None) -> dict[int, int]:
    """Hash of each distinct normalised line with words, and the words of all its occurrences."""
    out: dict[int, int] = {}
    for line in (text or "").split("\n"):
        n, h = _line(line)
        if n:
            out[h] = out.get(h, 0) + n
    return out


def without_lines(text: str, hashes: set[int]) -> str:
    """``text`` without the lines of these hashes; blank lines stay."""
    kept = []
    for line in text.split("\n"):
        n, h = _line(line)
        if not n or h not in hashes:
            kept.append(line)
    return "\n".join(kept)


def _measured():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _COUNTS.split(", ")]
        for docs in batches:
            counts = pd.DataFrame([base_counts(t) for t in docs["text"]], columns=names, dtype="int64")
            lines = [line_counts(t) for t in docs["text"]]
            yield pd.concat([docs[["doc_id", "__host", "__k1", "__k2"]].reset_index(drop=True), counts], axis=1).assign(
                lines=[list(x) for x in lines], line_words=[list(x.values()) for x in lines])

    return released(run)


def measure(docs: DataFrame) -> DataFrame:
    """Per row: base counts and hashed lines, stored without the text.  __k1, __k2 identify (source, text)."""
    keyed = with_key(text_batches(docs).select("doc_id", "source", "text"), "source", "text").withColumn(
        "__host", F.xxhash64(F.isnull("source"), F.coalesce("source", F.lit(""))))
    return cut_lineage(keyed.select("doc_id", "text", "__host", "__k1", "__k2").mapInPandas(
        _measured(),
        f"doc_id long, __host long, __k1 long, __k2 long, {_COUNTS}, lines array<long>, line_words array<int>"))


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def limited(measured: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST) -> DataFrame:
    """Documents (__k1, __k2) that lose lines above the limit: the hashes of these, and whether more than ``max_lost`` of the words go with them."""
    lines = measured.select("doc_id", "__host", "__k1", "__k2", "n_words", F.explode(F.arrays_zip("lines", "line_words")).alias("x"))
    held = lines.groupBy("__host", F.col("x.lines").alias("line"), "__k1", "__k2", "n_words", F.col("x.line_words").alias("words")).agg(
        F.min("doc_id").alias("first"))
    often = held.groupBy("__host", "line").agg(F.count("*").alias("docs"), F.min("first").alias("holder")).where(F.col("docs") > max_docs)
    # A line may be held by a third of all documents: salted on both sides.
    often = often.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = held.withColumn("salt", F.pmod("__k1", F.lit(SALTS)).cast("int")).join(often, ["__host", "line", "salt"]).where(
        ~F.col("first").eqNullSafe(F.col("holder")))
    # A document's list is part of its own lines.
    return lost.groupBy("__k1", "__k2", "n_words").agg(F.sum("words").alias("lost"), F.collect_list("line").alias("lines")).select(
        "__k1", "__k2", "lines", (F.col("lost") > max_lost * F.col("n_words")).alias("depleted"))


def depleted(measured: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST) -> DataFrame:
    """Keys of the documents that lose more than ``max_lost`` of their words with the lines above the limit."""
    return limited(measured, max_docs, max_lost).where("depleted").select("__k1", "__k2")


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_lost: float = MAX_LOST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): base counts, base_failed, kept.

    A null or empty text has no words and fails the base rules.  A null source
    is a host of its own.  Rows with null doc_id are judged like others, but
    never count as the first holder of a line.  Repeated rows get the same
    verdict.  An empty table gives no rows; other columns are not read.
    """
    measured = measure(docs)
    lost = depleted(measured, max_docs, max_lost).withColumn("__lost", F.lit(True))
    salted = lost.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["__k1", "__k2", "salt"], "left")
    return judged.select(
        "doc_id", *[c.split()[0] for c in _COUNTS.split(", ")], base_failed().alias("base_failed"),
        (~base_failed() & F.col("__lost").isNull()).alias("kept"))


def _cleaned():
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lines in batches:
            yield pd.Series([None if t is None else without_lines(t, set(x.tolist())) for t, x in zip(texts, lines)], dtype=object)

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        yield from released(run)(batches)

    return cleaned


def keep_good(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` without the rejected rows, and their texts without the lines above the limit; other columns unchanged.

    The copies of the first holder of a line keep it, like the holder itself.
    """
    measured = measure(docs)
    # Without lines: rejected.
    failed = measured.where(base_failed()).select("__k1", "__k2", F.lit(None).cast("array<long>").alias("lines"), F.lit(True).alias("rejected"))
    verdicts = limited(measured, **limits).select("__k1", "__k2", F.expr("IF(depleted, NULL, lines)").alias("lines"), F.col("depleted").alias("rejected"))
    verdicts = cut_lineage(verdicts.union(failed.distinct()).groupBy("__k1", "__k2").agg(F.max("rejected").alias("__rejected"), F.max("lines").alias("__lines")))
    judged = beside_keys(with_key(docs, "source", "text"), verdicts, F.col("doc_id"))
    judged = text_batches(judged).where(F.col("__rejected").isNull() | ~F.col("__rejected"))
    loses = F.col("__lines").isNotNull()  # other texts don't go to Python
    text = F.coalesce(_cleaned()(F.when(loses, F.col("text")), F.col("__lines")), F.col("text"))
    return judged.select(*[text.alias(c) if c == "text" else c for c in docs.columns])


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{folder}/documents.parquet"))


def op9_cleaned_text(spark: SparkSession, folder: str) -> DataFrame:
    """The kept documents, without the lines above the limit."""
    return keep_good(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text"))


_JUDGED = """
WITH d AS (SELECT row_number() OVER () r, doc_id, coalesce(source, chr(0)) source, coalesce(text, '') text FROM documents),
ws AS (SELECT r, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') w FROM d),
wi AS (SELECT r, unnest(w) w, generate_subscripts(w, 1) i FROM ws),
win AS (SELECT r, i, CASE WHEN lead(w, 7) OVER p IS NULL THEN NULL ELSE
  concat_ws(' ', w, lead(w, 1) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p, lead(w, 5) OVER p, lead(w, 6) OVER p, lead(w, 7) OVER p) END k
  FROM wi WINDOW p AS (PARTITION BY r ORDER BY i)),
dup AS (SELECT r, i, (k IS NOT NULL AND count(*) OVER (PARTITION BY r, k) > 1)::INT twice FROM win),
cov AS (SELECT r, i, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) inside FROM dup),
rep AS (SELECT r, sum(inside)::BIGINT n FROM cov GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) l FROM d),
lw AS (SELECT r, l, regexp_extract_all(l, '[^ \\t\\n\\x0B\\f\\r]+') w FROM ln),
dl AS (SELECT r, (count(*) - count(DISTINCT l))::BIGINT n FROM lw WHERE len(w) > 0 GROUP BY r),
b AS (SELECT d.r, doc_id, source, text, len(w)::BIGINT n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols, coalesce(dl.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words
  FROM d JOIN ws USING (r) LEFT JOIN dl USING (r) LEFT JOIN rep USING (r)),
sl AS (SELECT source, text, any_value(n_words) n_words, lower(array_to_string(w, ' ')) line, any_value(doc) first, sum(len(w)) / any_value(times) words
  FROM lw JOIN b USING (r) JOIN (SELECT source s, text t, min(doc_id) doc, count(*) times FROM b GROUP BY 1, 2) g ON g.s = source AND g.t = text
  WHERE len(w) > 0 GROUP BY source, text, line),
often AS (SELECT source, line, min(first) holder FROM sl GROUP BY 1, 2 HAVING count(*) > 20),
ll AS (SELECT source, text, sum(words) > 0.5 * any_value(n_words) depleted, list(line) ls FROM sl JOIN often USING (source, line) WHERE first <> holder GROUP BY source, text)
"""
ORACLE = _JUDGED + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(depleted, false) kept
FROM b LEFT JOIN ll USING (source, text)
"""
CLEANED_ORACLE = _JUDGED + """
SELECT doc_id, nullif(source, chr(0)) source, CASE WHEN ls IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda l:
  NOT list_contains(ls, lower(array_to_string(regexp_extract_all(l, '[^ \\t\\n\\x0B\\f\\r]+'), ' ')))), chr(10)) END AS text
FROM b LEFT JOIN ll USING (source, text) WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT coalesce(depleted, false)
"""
