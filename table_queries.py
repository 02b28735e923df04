"""Queries of exports, stored tables, orders and rare branches, with their DuckDB statements.

Tables are written and read back; branches that the supplied data does not reach are
reached by rows derived from all of it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from oracle_queries import CLUSTERS, EXACT as EXACT_SQL, LINES, USABLE, TOKENS, features, fx, sim
from pricebench import MatchConfig
from pricebench.operators import quality as Q
from pricebench.operators.clusters import build_clusters, in_cluster_order
from pricebench.operators.evidence import dispute_pack
from pricebench.operators.fingerprint import snapshot_id
from pricebench.operators.grouping import assign_clusters
from pricebench.operators.ordering import stored_order
from pricebench.operators.pairs import candidate_pairs
from pricebench.plans import analytics as A
from pricebench.session import checkpoint_dir
from pricebench.sources.documents import first_documents, read_scans
from pricebench.sources.exports import export_dataset, export_outputs, export_pack, export_worklist
from pricebench.sources.star import raw_lines, read_table
from pricebench.sources.store import line_table, load_lines, seed_lines
from pricebench.sources.tabular import read_labelled_pairs, write_csv

EXACT, HYBRID, DEFAULT = MatchConfig(mode="exact-pn"), MatchConfig(mode="hybrid"), MatchConfig()


def _place(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/tables-{uuid.uuid4().hex}"


def _positions(ordered: DataFrame) -> DataFrame:
    """An ordered table with the place of each row: ids of a sorted table rise with its order."""
    return stored_order(ordered.withColumn("_o", F.monotonically_increasing_id()), "_o", out="position").drop("_o")


def _csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Money, plain numbers, and names with short, long and zero-filled numbers."""
    k = F.col("p_partkey").cast("long")
    text = (F.when(k % 4 == 0, F.concat(F.lit("S$ "), k.cast("string"), F.lit(".5"))).when(k % 4 == 1, F.concat(F.lit("Part "), k.cast("string")))
            .when(k % 4 == 2, F.concat(F.lit("pArt "), F.repeat(F.lit("9"), (k % 9 + 20).cast("int")), k.cast("string"))).otherwise(F.concat(F.lit("x"), F.lpad(k.cast("string"), 30, "0"), F.lit("-b"))))
    return read_table(spark, folder, "part").select(k.alias("part"), text.alias("label"))


def _loaded(spark: SparkSession, folder: str, lines: Callable) -> DataFrame:
    """Lines stored with blanks; seeding a filled table leaves it alone."""
    seq, table = F.col("seq"), line_table(_place(spark))
    table.replace(lines(spark, folder).withColumns({
        "make": F.when(seq % 3 == 0, "").otherwise(F.col("make")), "model": F.when(seq % 5 == 0, None).otherwise(F.col("model")),
        "qty": F.when(seq % 7 == 0, None).otherwise(F.col("qty")), "cat": F.when(seq % 2 == 0, "").otherwise(F.col("cat")), "src": F.lit(None).cast("string")}))
    seed_lines(table, raw_lines(spark, folder))
    return load_lines(spark, table).select("id", "make", "model", "cat", "qty", "src", "gst", F.col("bill_dt").cast("string").alias("bill_dt"))


def _parts_sheet(spark: SparkSession, folder: str, lines: Callable, clusters: Callable, variants: Callable, sheet: str) -> DataFrame:
    path = _place(spark)
    export_dataset(lines(spark, folder), clusters(spark, folder, EXACT), variants(spark, folder, EXACT), path, "gzip")
    rows = _csv(spark, f"{path}/{sheet}")
    if sheet == "parts":
        return rows.select("bill_no", "supplier", "part_name", "part_number", "npn", *[F.col(c).cast("double").alias(c) for c in ("qty", "unit", "total")])
    return rows.select("Cluster", "Make", F.col("Quotes").cast("long").alias("Quotes"), "Variants", "Suppliers", F.col("Median").cast("double").alias("Median"), F.col("CV_pct").cast("double").alias("CV_pct"), "Reliable")


def _worklist(spark: SparkSession, folder: str, grouped: Callable, clusters: Callable, variants: Callable) -> DataFrame:
    path, c = _place(spark), clusters(spark, folder, EXACT)
    keys = c.where("make = 'Brand#31' or make = 'Brand#3'").select("key", F.col("cluster_order.ord_first").alias("position"))
    export_worklist(keys, c, variants(spark, folder, EXACT), grouped(spark, folder, EXACT), path)
    quotes = _csv(spark, f"{path}/evidence").groupBy("position").agg(F.count("*").alias("evidence"))
    return _csv(spark, f"{path}/worklist").join(quotes, "position").select(
        "part", "make", F.col("quotes").cast("long").alias("quotes"), F.col("median").cast("double").alias("median"), F.col("mean").cast("double").alias("mean"), "reliable", "evidence")


def _with_tokens(judged: DataFrame) -> DataFrame:
    k = F.col("file_name").cast("long")
    return judged.withColumns({"input_tokens": k % 97, "output_tokens": k % 13})


def _imported(spark: SparkSession, folder: str, judged: Callable, sheet: str) -> DataFrame:
    path = _place(spark)
    export_outputs(_with_tokens(judged(spark, folder)), path, "gzip")
    rows = _csv(spark, f"{path}/{sheet}")
    if sheet == "import":
        return rows.select(F.col("Supplier").alias("supplier"), F.col("Bill No").alias("bill_no"), F.col("Part Name").alias("part_name"), F.col("Qty").cast("double").alias("qty"),
                           F.col("Total Cost").cast("double").alias("total"), F.coalesce("Review", F.lit("")).alias("review"))
    return rows.select("file", "status", "supplier", "bill_no", F.col("lines").cast("long").alias("lines"), "reconciliation",
                       F.col("input_tokens").cast("long").alias("input_tokens"), F.col("output_tokens").cast("long").alias("output_tokens"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs whose names hold commas, quotes and line breaks, written and read back."""
    k, path = F.col("p_partkey").cast("long"), _place(spark)
    rows = read_table(spark, folder, "part").select(
        k.alias("pair_id"), F.concat(F.col("p_name"), F.lit(', "'), k.cast("string"), F.lit('"\nLH')).alias("part_name_a"), F.concat(F.lit('"'), F.col("p_name")).alias("part_name_b"),
        F.when(k % 3 == 0, "y").when(k % 3 == 1, "n").otherwise("").alias("label"))
    write_csv(rows, path)
    return read_labelled_pairs(spark, path).select(F.col("pair_id").cast("long").alias("pair_id"), "part_name_a", "part_name_b", F.coalesce("label", F.lit("")).alias("label"))


def _scans(spark: SparkSession, folder: str) -> DataFrame:
    """A file for each supplier, read as bytes; a file goes by the name of its folder, as tasks name what they write."""
    path, tasks = _place(spark), 4 * spark.sparkContext.defaultParallelism
    rows = read_table(spark, folder, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("value"), F.monotonically_increasing_id().alias("_at"))
    rows.repartition(tasks, "k").sortWithinPartitions("k", "_at").drop("_at").write.partitionBy("k").text(path)
    files = read_scans(spark, path, nested="*.txt").withColumn("file_name", F.element_at(F.split("path", "/"), -2))
    return files.withColumn("k", F.regexp_extract("path", "k=([0-9]+)", 1).cast("long"))


def _odd_numbers(lines: DataFrame) -> DataFrame:
    """Every fifth line has no part number, every fifth a small whole number."""
    part = F.substring("npn", 3, 20).cast("long")
    return lines.withColumn("npn", F.when(F.col("seq") % 5 == 0, "").when(F.col("seq") % 5 == 1, (part % 50).cast("string")).otherwise(F.col("npn")))


def _odd_groups(lines: DataFrame, cfg: MatchConfig) -> DataFrame:
    table = in_cluster_order(build_clusters(assign_clusters(_odd_numbers(lines), cfg), cfg))
    return _positions(table.select(F.col("cluster_id").cast("string").alias("cluster_id"), "n", "med"))


def _single(lines: DataFrame) -> DataFrame:
    """Every line a part of its own: no part has two quotes."""
    clusters = build_clusters(assign_clusters(lines.withColumn("npn", F.col("id")), EXACT), EXACT)
    return A.benchmark_view(clusters).select(F.col("cluster_id").cast("string").alias("cluster_id"), "n", "med")


def _unlike_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Names that have nothing in common: only the systematic sample is left."""
    part = read_table(spark, folder, "part")
    k = F.col("p_partkey").cast("long")
    rows = part.select(k.alias("seq"), F.lit("Supplier Part").alias("ltype"), F.col("p_brand").alias("make"), F.concat(F.lit("N"), k.cast("string")).alias("npn"), F.md5(k.cast("string")).alias("part_name"),
                       k.cast("string").alias("part_number"), F.lit("s").alias("supplier"), F.lit(1.0).alias("unit"), F.lit("Other").alias("cat"))
    return candidate_pairs(rows).select("pair_id", "similarity", "label", "part_name_a", "part_name_b", "make")


def _pack(spark: SparkSession, folder: str, assessment: Callable, grouped: Callable, variants: Callable, lines: Callable) -> DataFrame:
    path, rows = _place(spark), lines(spark, folder)
    pack = dispute_pack(assessment(spark, folder), grouped(spark, folder), variants(spark, folder), rows, DEFAULT, snapshot_id(rows, DEFAULT), "2001-08-02")
    export_pack(pack, path)
    counts = [_csv(spark, f"{path}/{t}").groupBy("claim_ref").agg(F.count("*").alias("rows")).withColumn("table", F.lit(t)) for t in pack]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def queries(lines: Callable, grouped: Callable, clusters: Callable, variants: Callable, judged: Callable, assessment: Callable) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    C, V = clusters, variants
    shown = lambda df, *more: _positions(df.select("label", "make", "n", *more))
    return {
        "l1_ordered": lambda s, d: _positions(A.order_by_any(_labels(s, d), "label")),
        "l1_ordered_down": lambda s, d: _positions(A.order_by_any(_labels(s, d), "label", descending=True)),
        "l3_lookup_order": lambda s, d: shown(A.lookup(C(s, d, EXACT), V(s, d, EXACT), name="ring"), "med"),
        "s4_loaded": lambda s, d: _loaded(s, d, lines),
        "s10_parts": lambda s, d: _parts_sheet(s, d, lines, C, V, "parts"),
        "s10_benchmark": lambda s, d: _parts_sheet(s, d, lines, C, V, "benchmark"),
        "s11_worklist": lambda s, d: _worklist(s, d, grouped, C, V),
        "s12_import": lambda s, d: _imported(s, d, judged, "import"),
        "a22_run_log": lambda s, d: _imported(s, d, judged, "run_log"),
        "a22_costs": lambda s, d: Q.run_report(_with_tokens(judged(s, d)), 0.3, 2.5),
        "s14_pairs": _pairs,
        "e27_scans": lambda s, d: _scans(s, d).select("k", "length", "sha256"),
        "l8_first": lambda s, d: first_documents(_scans(s, d), 25).select("k"),
        "c1_blank_numbers": lambda s, d: _odd_groups(lines(s, d), EXACT),
        "c4_blank_numbers": lambda s, d: _odd_groups(lines(s, d), HYBRID),
        "l4_single_quotes": lambda s, d: _single(lines(s, d)),
        "w5_sample": _unlike_pairs,
        "k4_pack": lambda s, d: _pack(s, d, assessment, grouped, variants, lines),
    }


_LABELS = """lb AS (SELECT p_partkey::BIGINT AS part, CASE p_partkey%4 WHEN 0 THEN 'S$ '||p_partkey||'.5' WHEN 1 THEN 'Part '||p_partkey WHEN 2 THEN 'pArt '||repeat('9',(p_partkey%9+20)::INT)||p_partkey
  ELSE 'x'||lpad(p_partkey::VARCHAR,30,'0')||'-b' END AS label FROM part),
ky AS (SELECT *, CASE WHEN part%4=0 THEN part+0.5 END AS num, array_to_string(list_transform(regexp_extract_all(lower(label),'[0-9]+|[^0-9]+'),
  lambda p: CASE WHEN regexp_matches(p,'^[0-9]') THEN lpad(len(ltrim(p,'0'))::VARCHAR,10,'0')||ltrim(p,'0') ELSE p END),'') AS key FROM lb)"""
_ODD = f"{LINES}, {USABLE}, o AS (SELECT * REPLACE (CASE WHEN seq%5=0 THEN '' WHEN seq%5=1 THEN (substr(npn,3)::BIGINT%50)::VARCHAR ELSE npn END AS npn) FROM u)"


def _odd_sql(key: str, whole: str) -> str:
    return f"""WITH {_ODD}, g0 AS (SELECT {key} AS cluster_id, min(seq) AS cord, count(*) AS n, list_sort(list(unit)) AS us FROM o GROUP BY 1)
SELECT cluster_id, n, {fx('((us[(n-1)//2+1]+us[n//2+1])/2)', 2)} AS med, row_number() OVER (ORDER BY n DESC, {whole}, cord)-1 AS position FROM g0"""


def oracles(old: dict[str, str]) -> dict[str, str]:
    """``old``: the statements of other queries, of which some say what was written."""
    whole = "CASE WHEN regexp_full_match(cluster_id,'0|[1-9][0-9]{0,9}') AND cluster_id::BIGINT<4294967295 THEN cluster_id::BIGINT ELSE 4294967296 END"
    chain = f"WITH RECURSIVE {EXACT_SQL}, {CLUSTERS}"
    listed = lambda column, mark: f"(SELECT string_agg(x, '{mark}' ORDER BY f) FROM (SELECT {column} AS x, min(mr) AS f FROM g WHERE g.cluster_id=c.cluster_id GROUP BY 1))"
    ingest = old["q2_ingest"].split(" SELECT file_name, status, CASE WHEN good")[0]
    return {
        "l1_ordered": f"WITH {_LABELS} SELECT part, label, row_number() OVER (ORDER BY num IS NULL, num, key)-1 AS position FROM ky",
        "l1_ordered_down": f"WITH {_LABELS} SELECT part, label, row_number() OVER (ORDER BY num IS NULL DESC, num DESC, key DESC)-1 AS position FROM ky",
        "l3_lookup_order": f"{chain} SELECT label, make, n, med, row_number() OVER (ORDER BY n DESC, med DESC, {whole}, cord)-1 AS position FROM c WHERE contains(lower(label),'ring') "
                           "OR cluster_id IN (SELECT cluster_id FROM g WHERE contains(lower(part_name),'ring'))",
        "s4_loaded": f"WITH {LINES} SELECT id, CASE WHEN seq%3=0 THEN 'Unknown' ELSE make END AS make, CASE WHEN seq%5=0 THEN '—' ELSE model END AS model, CASE WHEN seq%2=0 THEN 'Other' ELSE cat END AS cat, "
                     "CASE WHEN seq%7=0 THEN 1.0 ELSE qty END AS qty, 'excel' AS src, 'unknown' AS gst, CAST(bill_dt AS VARCHAR) AS bill_dt FROM l",
        "s10_parts": f"WITH {LINES} SELECT bill_no, supplier, part_name, part_number, npn, qty, unit, total FROM l",
        "s10_benchmark": f"{chain} SELECT label AS \"Cluster\", make AS \"Make\", n AS \"Quotes\", {listed('part_name', ' | ')} AS \"Variants\", {listed('supplier', ', ')} AS \"Suppliers\", med AS \"Median\", cv AS \"CV_pct\", "
                         "CASE WHEN n>1 THEN CASE WHEN reliable THEN 'yes' ELSE 'no' END END AS \"Reliable\" FROM c",
        "s11_worklist": f"{chain}, w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, cord) AS rn FROM c WHERE make IN ('Brand#31','Brand#3')) SELECT label AS part, make, n AS quotes, med AS median, avg AS mean, "
                        "CASE WHEN n=1 THEN 'single quote' WHEN reliable THEN 'yes' ELSE 'no' END AS reliable, n AS evidence FROM w WHERE rn=1",
        "s12_import": ingest + " SELECT sup AS supplier, nullif(bn,'') AS bill_no, part_name, qty, total, CASE WHEN status='review' THEN 'yes' ELSE '' END AS review FROM j JOIN l ON CAST(substr(l.bill_no,2) AS BIGINT)=k WHERE status IN ('done','review')",
        "a22_run_log": ingest + " SELECT file_name AS file, status, CASE WHEN good THEN sup END AS supplier, CASE WHEN good THEN nullif(bn,'') END AS bill_no, CASE WHEN status IN ('done','review') THEN n END AS lines, "
                       "CASE status WHEN 'review' THEN 'MISMATCH' WHEN 'done' THEN CASE WHEN st=0 THEN 'nothing printed to check' ELSE 'ok' END END AS reconciliation, k%97 AS input_tokens, k%13 AS output_tokens FROM j",
        "a22_costs": ingest + f", t AS (SELECT count(*) AS files_total, count(*) FILTER (status='done') AS done, count(*) FILTER (status='review') AS review, count(*) FILTER (status='duplicate') AS duplicate, "
                     "count(*) FILTER (status='failed') AS failed, coalesce(sum(n) FILTER (status IN ('done','review')),0)::BIGINT AS part_rows_exported, sum(k%97)::BIGINT AS input_tokens, sum(k%13)::BIGINT AS output_tokens FROM j) "
                     f"SELECT *, {fx('(input_tokens/1e6::DOUBLE*0.3::DOUBLE+output_tokens/1e6::DOUBLE*2.5::DOUBLE)', 2)} AS estimated_cost FROM t",
        "s14_pairs": "SELECT p_partkey::BIGINT AS pair_id, p_name||', \"'||p_partkey||'\"'||chr(10)||'LH' AS part_name_a, '\"'||p_name AS part_name_b, CASE p_partkey%3 WHEN 0 THEN 'y' WHEN 1 THEN 'n' ELSE '' END AS label FROM part",
        "e27_scans": "SELECT s_suppkey::BIGINT AS k, (strlen(s_name)+1)::BIGINT AS length, sha256(s_name||chr(10)) AS sha256 FROM supplier",
        "l8_first": "SELECT s_suppkey::BIGINT AS k FROM supplier ORDER BY s_suppkey::VARCHAR LIMIT 25",
        "c1_blank_numbers": _odd_sql("CASE WHEN npn='' THEN '?' ELSE npn END", whole),
        "c4_blank_numbers": _odd_sql("CASE WHEN npn='' THEN '~'||id ELSE npn END", whole),
        "l4_single_quotes": f"WITH {LINES}, {USABLE} SELECT id AS cluster_id, 1 AS n, {fx('unit', 2)} AS med FROM u ORDER BY seq LIMIT 25",
        "w5_sample": f"""WITH v0 AS (SELECT p_partkey AS seq, p_brand AS make, md5(p_partkey::VARCHAR) AS part_name FROM part), v AS (SELECT *, {TOKENS} FROM (SELECT *, {features('part_name')} FROM v0)),
pr AS (SELECT x.seq AS i, y.seq AS j, x.make, x.part_name AS a, y.part_name AS b, {sim('x', 'y')} AS score FROM v x JOIN v y ON x.make=y.make AND x.seq<y.seq),
lo AS (SELECT *, row_number() OVER (ORDER BY i, j)-1 AS r, count(*) OVER () AS t FROM pr WHERE score<0.3),
pk AS (SELECT * FROM lo WHERE r%greatest(1,t//40)=0 AND r//greatest(1,t//40)<40 UNION ALL SELECT *, 0, 0 FROM pr WHERE score>=0.3)
SELECT row_number() OVER (ORDER BY score DESC, score<0.3, i, j) AS pair_id, {fx('score', 4)} AS similarity, '' AS label, a AS part_name_a, b AS part_name_b, make FROM pk""",
        "k4_pack": " UNION ALL ".join(f"SELECT claim_ref, count(*) AS rows, '{t}' AS \"table\" FROM ({old[q]}) GROUP BY 1" for t, q in (("summary", "a24_summary"), ("lines", "k2_lines"), ("evidence", "k3_evidence"))),
    }
