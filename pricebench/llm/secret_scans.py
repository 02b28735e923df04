"""Secret scans by a ledger of blobs.

Every version of every document is addressed by the hash of its content.  A
ledger tells which rules, in which version, have seen a blob; only unseen pairs
are scanned, each blob once, and findings are joined back to all documents that
hold the blob.  Rules are patterns of Spark's own regular expressions: the places
of matches follow from the lengths of what lies between them.
"""

from __future__ import annotations

import functools
import operator
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.utils import AnalysisException

from pricebench.llm.common import SALTS, cut_lineage
from pricebench.session import checkpoint_dir


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` count if its ``group`` (0: all of it) has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which kinds are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # shorter runs can't pass, and a run is matched whole
    # Signed web tokens and private keys in text form.
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\r\n]*-----END [A-Z ]*PRIVATE KEY-----", 0, 60),
)
BASE = ("assign", "access", "hex")
_LEDGER = "blob binary, rules array<string>, spans array<struct<start: bigint, rule: string, end: bigint>>"


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """(blob, rules, spans): what has been scanned, one row for each blob and run."""
    try:
        return spark.read.schema(_LEDGER).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def _matches(rule: Rule) -> Column:
    """Per match of a rule: its place among them, the characters before it since the last one, its length, and whether it counts."""
    gaps = F.split("text", rule.pattern, -1)
    hit = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hit
    zipped = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hit, F.length).alias("size"), F.transform(value, F.length).alias("value"))
    rows = F.transform(zipped, lambda x, i: F.struct(
        F.lit(rule.name).alias("rule"), i.alias("at"), x["gap"].cast("long").alias("gap"), x["size"].cast("long").alias("size"), (x["value"] >= rule.least).alias("counts")))
    rows = F.filter(rows, lambda x: x["size"].isNotNull())  # what follows the last match
    return F.when(F.array_contains("missing", rule.name) & F.col("text").rlike(rule.pattern), rows)


def scan_blobs(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows of ``texts`` (blob, missing, text), of which each is scanned with its missing rules."""
    none = F.array().cast("array<struct<rule: string, at: int, gap: bigint, size: bigint, counts: boolean>>")
    found = texts.select("blob", "missing", F.flatten(F.array(*[F.coalesce(_matches(r), none) for r in rules])).alias("found"))
    rows = found.select("blob", "missing", F.explode_outer("found").alias("m")).select("blob", "missing", "m.*")
    # A blob that came twice gives the same rows twice.
    rows = rows.repartition("blob").dropDuplicates(["blob", "rule", "at"])
    so_far = Window.partitionBy("blob", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
    span = F.when(F.col("counts"), F.struct((F.col("end") - F.col("size")).alias("start"), "rule", "end"))
    return placed.groupBy("blob").agg(F.first("missing").alias("rules"), F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, spans) per row of ``docs`` (doc_id, text); ``ledger``, a folder, learns what was scanned.

    spans: array of (start, rule, end) of the given rules in code points, end
    exclusive, by start and then by the order of ``rules``.  A null text is an
    empty one.  Null ids and repeated rows are rows like others.  An empty table
    gives no rows; other columns are not read.  A run that is lost before it is
    written leaves the ledger as it was; a pair that two runs scanned counts once.
    """
    spark = docs.sparkSession
    versions = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    paths = cut_lineage(versions.select("doc_id", "blob"))
    seen = read_ledger(spark, ledger)
    first_run = not seen.limit(1).count()
    names = F.array(*[F.lit(r.name) for r in rules])
    known = seen.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("known"))
    # One document stands for its copies: the one that is read.
    holder = F.struct(F.isnull("doc_id").alias("nameless"), F.coalesce("doc_id", F.lit(0)).alias("holder"))
    blobs = paths.groupBy("blob").agg(F.min(holder).alias("h")).select("blob", "h.*")
    unseen = blobs.join(known, "blob", "left").withColumn("missing", F.array_except(names, F.coalesce("known", F.array().cast("array<string>"))))
    unseen = cut_lineage(unseen.where(F.size("missing") > 0).drop("known"))
    # The first run needs nearly all texts; later ones leave it to the optimizer to broadcast the few blobs that are new.
    wanted = unseen.hint("merge") if first_run else unseen
    held = versions.select("text", "blob", F.coalesce("doc_id", F.lit(0)).alias("holder"), F.isnull("doc_id").alias("nameless"))
    scan_blobs(held.join(wanted, ["blob", "holder", "nameless"]).select("blob", "missing", "text"), rules).write.mode("append").parquet(ledger)

    wanted = {r.name: i for i, r in enumerate(rules)}
    place = F.create_map(*[x for name, i in wanted.items() for x in (F.lit(name), F.lit(i))])
    spans = read_ledger(spark, ledger).select("blob", F.explode("spans").alias("s")).where(F.col("s.rule").isin(*wanted))
    listed = F.array_sort(F.collect_set(F.struct(F.col("s.start").alias("start"), place[F.col("s.rule")].alias("place"), F.col("s.end").alias("end"), F.col("s.rule").alias("rule"))))
    found = spans.groupBy("blob").agg(listed.alias("found")).select("blob", F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["rule"].alias("rule"), x["end"].alias("end"))).alias("spans"))
    # A third of all documents may hold one blob: both sides are salted; blobs without findings meet nothing.
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    paths = paths.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return paths.join(found, ["blob", "salt"], "left").select(
        "doc_id", "blob", F.coalesce("spans", F.array().cast("array<struct<start: bigint, rule: string, end: bigint>>")).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.substring_index(x["rule"], "@", 1), x["start"], x["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Per document the counts of base spans, their hash, and all spans as text."""
    kind = lambda x: F.substring_index(x["rule"], "@", 1)
    counts = [F.size(F.filter(F.transform("spans", kind), functools.partial(operator.eq, F.lit(k)))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda x: kind(x).isin(*BASE))
    return scanned.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op13_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    ledger = f"{checkpoint_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    return digest(scan(spark.read.parquet(f"{folder}/documents.parquet"), ledger))


_ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
           "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)")
ORACLE = f"""
WITH k(place, kind, base, pattern, grp, least) AS (VALUES (0, 'assign', true, '{_ASSIGN}', 2, 6), (1, 'access', true, 'AKIA[A-Z0-9]+', 0, 20), (2, 'hex', true, '[0-9a-f]+', 0, 24),
  (3, 'jwt', false, '{RULES[3].pattern}', 0, 40), (4, 'pem', false, '{RULES[4].pattern}', 0, 60)),
d AS (SELECT row_number() OVER () r, doc_id, coalesce(text, '') text FROM documents),
a AS (SELECT r, 0 place, string_split_regex(text, '{_ASSIGN}') gaps, regexp_extract_all(text, '{_ASSIGN}') hits, regexp_extract_all(text, '{_ASSIGN}', 2) vals FROM d
  UNION ALL SELECT r, 1, string_split_regex(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, 2, string_split_regex(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+') FROM d
  UNION ALL SELECT r, 3, string_split_regex(text, '{RULES[3].pattern}'), regexp_extract_all(text, '{RULES[3].pattern}'), regexp_extract_all(text, '{RULES[3].pattern}') FROM d
  UNION ALL SELECT r, 4, string_split_regex(text, '{RULES[4].pattern}'), regexp_extract_all(text, '{RULES[4].pattern}'), regexp_extract_all(text, '{RULES[4].pattern}') FROM d),
m AS (SELECT r, place, i, length(gaps[i]) gap, length(hits[i]) size, length(vals[i]) val FROM a, unnest(range(1, len(hits) + 1)) u(i)),
p AS (SELECT r, place, sum(gap + size) OVER (PARTITION BY r, place ORDER BY i) stop, size, val FROM m),
s AS (SELECT r, place, kind, base, (stop - size)::BIGINT start, stop::BIGINT stop FROM p JOIN k USING (place) WHERE val >= least),
j AS (SELECT r, count(*) FILTER (kind = 'assign') n_assign, count(*) FILTER (kind = 'access') n_access, count(*) FILTER (kind = 'hex') n_hex,
  string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) FILTER (base) b, string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, place) spans FROM s GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(spans, '') spans
FROM d LEFT JOIN j USING (r)
"""
