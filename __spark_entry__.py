"""Registered queries and their DuckDB counterparts.

``queries()`` builds every query over the whole supplied tables.  Lines, groups
and benchmark tables that several queries start from are built once per session
and folder and stored as Parquet tables, which filters and column lists reach.
"""

from __future__ import annotations

import datetime as dt
import os
import sys
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import recent_queries  # noqa: E402
import table_queries  # noqa: E402
from oracle_queries import oracles  # noqa: E402
from pricebench import MatchConfig  # noqa: E402
from pricebench.functions.similarity import with_name_features  # noqa: E402
from pricebench.operators import quality as Q  # noqa: E402
from pricebench.functions import parts as P  # noqa: E402
from pricebench.operators.assess import assess, parse_claims, totals  # noqa: E402
from pricebench.operators.clusters import build_clusters, cluster_variants, in_cluster_order  # noqa: E402
from pricebench.operators.enrich import enrich_lines, upgrade_lines  # noqa: E402
from pricebench.operators.evaluate import operating_points, printed_sweep, sweep  # noqa: E402
from pricebench.operators.evidence import evidence_table, line_table, summary_table, worklist  # noqa: E402
from pricebench.operators.fingerprint import snapshot_id  # noqa: E402
from pricebench.operators.grouping import assign_clusters, usable  # noqa: E402
from pricebench.operators.pairs import candidate_pairs  # noqa: E402
from pricebench.operators.snapshots import load_snapshot, save_snapshot  # noqa: E402
from pricebench.plans import analytics as A  # noqa: E402
from pricebench.operators.ordering import stored_order  # noqa: E402
from pricebench.session import checkpoint_dir, cut_lineage, only_result, scratch  # noqa: E402
from pricebench.sources.star import raw_lines, read_table  # noqa: E402
from pricebench.sources.documents import stream_answer_lines  # noqa: E402
from pricebench.sources.store import activity_table, append_lines, keep_newest, last_per_id, line_table as stored_lines, load_lines, newest_events, normal_events, stream_batch  # noqa: E402
from pricebench.sources.tabular import read_bill_sheet  # noqa: E402
from pricebench.streaming import activity, bills  # noqa: E402

try:
    import corpus_pipeline
    import pricebench.llm.queries as llm_queries
except ModuleNotFoundError as error:  # the training-data operators can be left out
    if error.name not in ("corpus_pipeline", "pricebench.llm", "pricebench.llm.queries"):
        raise
    LLM_QUERIES, LLM_ORACLES = {}, {}
else:
    LLM_QUERIES = llm_queries.queries() | {"pipeline": corpus_pipeline.run}
    LLM_ORACLES = llm_queries.oracles() | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

DEFAULT = MatchConfig()
EXACT = MatchConfig(mode="exact-pn")
CATEGORY = MatchConfig(mode="category")
HYBRID = MatchConfig(mode="hybrid")
BRIDGED = MatchConfig(mode="hybrid", bridge=True)
AS_OF = dt.date(2001, 8, 2)

_kept: dict[tuple, DataFrame] = {}


def _keep(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _kept:
        _kept[key] = only_result(spark, build)
    return _kept[key]


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return _keep(spark, folder, "lines", lambda: enrich_lines(raw_lines(spark, folder)))


def some_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The lines for a query that reads few of their columns: stored ones if there are any, else only these columns are worked out."""
    stored = _kept.get((spark.sparkContext.applicationId, folder, "lines"))
    return enrich_lines(raw_lines(spark, folder)) if stored is None else stored


def grouped(spark: SparkSession, folder: str, cfg: MatchConfig = DEFAULT) -> DataFrame:
    build = lambda: assign_clusters(lines(spark, folder), cfg)
    # The other modes only add a key to the stored lines.
    if cfg.mode == "fuzzy-name" or cfg.bridge:
        return _keep(spark, folder, f"grouped-{cfg.fingerprint()}", build)
    return build()


def variants(spark: SparkSession, folder: str, cfg: MatchConfig = DEFAULT) -> DataFrame:
    return _keep(spark, folder, f"variants-{cfg.fingerprint()}", lambda: cluster_variants(grouped(spark, folder, cfg)))


def clusters(spark: SparkSession, folder: str, cfg: MatchConfig = DEFAULT) -> DataFrame:
    return _keep(
        spark, folder, f"clusters-{cfg.fingerprint()}",
        lambda: build_clusters(grouped(spark, folder, cfg), cfg, variants(spark, folder, cfg)),
    )


def _benchmark(cfg: MatchConfig) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        table = build_clusters(grouped(spark, folder, cfg), cfg)
        return in_cluster_order(table).withColumn("cluster_id", F.col("cluster_id").cast("string")).drop("cluster_order")

    return run


def _shown(df: DataFrame, *dropped: str) -> DataFrame:
    if "cluster_id" in df.columns:
        df = df.withColumn("cluster_id", F.col("cluster_id").cast("string"))
    return df.drop("cluster_order", *dropped)


def claims(spark: SparkSession, folder: str) -> DataFrame:
    """Every repair-estimate line as a claim line; some state no part number, no make or an unknown part."""
    seq = F.col("seq")
    noun = F.try_element_at(F.split("part_name", " "), F.lit(2))
    return lines(spark, folder).where(F.col("ltype") == "Repair Estimate").select(
        F.col("bill_no").alias("claim_ref"), seq.alias("line_no"),
        F.when(seq % 20 < 10, F.col("part_number")).otherwise("").alias("part_no"),
        F.when(seq % 70 < 10, F.concat(F.lit("UNLISTED "), noun, F.lit(" THING"))).otherwise(F.col("part_name")).alias("name"),
        F.col("unit").alias("quoted"), F.when(seq % 30 < 20, F.col("make")).otherwise("").alias("make"),
    )


def assessment(spark: SparkSession, folder: str) -> DataFrame:
    return _keep(
        spark, folder, "assessment",
        lambda: assess(claims(spark, folder), clusters(spark, folder), variants(spark, folder), DEFAULT),
    )


_ASSESSED = ("claim_ref", "line_no", "pn", "name", "claim_make", "quoted", "bench", "over", "over_pct", "how", "score",
             "near_label", "near_make", "near_score", "n", "flagged", "upper_bound", "above_bound", "cluster_id")


def documents(spark: SparkSession, folder: str, of: Callable[[SparkSession, str], DataFrame] = lines) -> DataFrame:
    """One answer text per bill; bill numbers repeat, totals and some answers are wrong."""
    rows = of(spark, folder).withColumn("k", F.substring("bill_no", 2, 20).cast("long"))
    part = F.struct("seq", "part_name", "part_number", "qty", F.col("total").alias("total_cost"))
    bills = rows.groupBy("k").agg(
        F.array_sort(F.collect_list(part)).alias("parts"), F.sum(F.col("total").cast("decimal(28,6)")).cast("double").alias("t")
    )
    bill = F.struct(
        F.concat(F.lit(" Supplier "), (F.col("k") % 2).cast("string")).alias("supplier_name"),
        F.when(F.col("k") % 11 == 0, "").otherwise(F.concat(F.lit("b"), F.floor(F.col("k") / 3).cast("string"))).alias("bill_no"),
        F.lit("12/03/2025").alias("bill_date"), F.lit("Toyota").alias("make"), F.lit("").alias("model"),
        F.when(F.col("k") % 13 == 0, "Receipt").otherwise("Tax Invoice").alias("doc_type"),
        F.lit("excl").alias("gst_treatment"),
        F.when(F.col("k") % 5 == 0, 0.0).when(F.col("k") % 4 == 0, F.col("t") + 5000).otherwise(F.col("t")).alias("parts_subtotal"),
        F.lit(0.0).alias("gst_amount"), F.lit(0.0).alias("invoice_total"),
        F.transform("parts", lambda p: F.struct(*[p.getField(c).alias(c) for c in ("part_name", "part_number", "qty", "total_cost")])).alias("parts"),
    )
    body = F.to_json(bill)
    text = F.when(F.col("k") % 17 == 0, "nothing to read here").otherwise(F.concat(F.lit("Here you are: ```json "), body, F.lit(" ```")))
    return bills.select(F.lpad(F.col("k").cast("string"), 12, "0").alias("file_name"), text.alias("text"))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return Q.with_document(_keep(spark, folder, "judged", lambda: Q.judge_documents(documents(spark, folder, some_columns)).drop("document")))


def events(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "events")
    return rows.select(
        F.col("event_id").alias("id"), "ts", F.col("event_type").alias("kind"), F.lit("").alias("action"),
        F.lit("").alias("message"), F.col("event_type").alias("source"), F.col("value").alias("count"),
        F.lit("ok").alias("status"), F.col("props").alias("detail"),
    )


def _upserted(spark: SparkSession, folder: str) -> DataFrame:
    first = events(spark, folder).withColumn("batch", F.lit(0))
    again = first.where(F.col("id") % 3 == 0).withColumns({"status": F.lit("warn"), "batch": F.lit(1)})
    rows = normal_events(first.unionByName(again)).withColumn("id", F.col("id").cast("string"))
    return last_per_id(rows, "id", F.col("batch")).select("id", "status")


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring lines of a bill, labelled by whether number or first words agree."""
    rows = lines(spark, folder).select("bill_no", "seq", "npn", "part_name")
    nxt = Window.partitionBy("bill_no").orderBy("seq")
    words = F.slice(F.split("part_name", " "), 1, 2)
    rows = rows.withColumn("w", words).withColumn("b", F.lead(F.struct("npn", "part_name", "w")).over(nxt)).where(F.col("b").isNotNull())
    same = (F.col("npn") == F.col("b.npn")) | (F.col("w") == F.col("b.w"))
    return rows.select(F.col("part_name").alias("part_name_a"), F.col("b.part_name").alias("part_name_b"), F.when(same, "y").otherwise("n").alias("label"))


def _written(spark: SparkSession, folder: str) -> DataFrame:
    """What bills write in other ways: makes, makes told by part numbers, tax, dates, models, amounts."""
    part = read_table(spark, folder, "part")
    k = F.col("p_partkey")
    written = F.element_at(F.array(*[F.lit(m) for m in ("toyota ", "MERC", "vw", "B.M.W.", "Unknown", "", "Mercedes Benz", "kia", "Acme")]), (k % 9 + 1).cast("int"))
    number = F.concat(F.element_at(F.array(*[F.lit(m) for m in ("MBN-", "hy ", "8K", "VN9", "M93", "MK1", "t12345", "513", "zz")]), (k % 7 + k % 3 + 1).cast("int")), k.cast("string"))
    npn = P.normal_part_number(number)
    gst = F.element_at(F.array(F.lit("INCL"), F.lit("excl"), F.lit("maybe"), F.lit("")), (k % 4 + 1).cast("int"))
    model = F.concat(F.col("p_type"), F.when(k % 2 == 0, " (old)").otherwise(""))
    amount = F.concat(F.lit("S$ "), F.format_number(k * 1.5, 2))
    date = F.when(k % 3 == 0, F.lit("dated 2021-02-31")).when(k % 3 == 1, F.concat((k % 28 + 1).cast("string"), F.lit("/2/21"))).otherwise("none")
    doc = F.when(k % 3 == 0, "Labour bill").when(k % 3 == 1, "repair ESTIMATE").otherwise("")
    return part.select(
        "p_partkey", npn.alias("npn"), P.canonical_make(written).alias("canonical"), P.make_of(npn, written).alias("make"), P.gst_of(gst).alias("gst"),
        P.model_key(model).alias("model"), P.money(amount).alias("amount"), P.bill_date_of(date).alias("bill_dt"), P.line_type(doc, F.lit("Other")).alias("ltype"))


def _claim_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = claims(spark, folder)
    price = F.col("quoted").cast("decimal(18,2)").cast("string")
    two = F.concat("name", F.lit(" | S$"), price)
    four = F.concat_ws("\t", F.when(F.col("part_no") == "", "none").otherwise(F.col("part_no")), "name", price, "make")
    return parse_claims(rows.select("claim_ref", "line_no", F.when(F.col("line_no") % 2 == 0, two).otherwise(four).alias("value")))


def _upgraded(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as an older writer left them: without category, grade, basis and type, prices as text."""
    old = lines(spark, folder).select("id", "seq", "part_name", "part_number", "supplier", "bill_no", "doc_type", F.col("qty").cast("string").alias("qty"),
                                      F.lit(0.0).alias("unit"), F.col("total").cast("decimal(18,2)").cast("string").alias("total"),
                                      F.when(F.col("seq") % 2 == 0, F.col("make")).otherwise("Unknown").alias("make"))
    return upgrade_lines(old).select("id", "make", "npn", "cat", "ltype", "qty", "unit", "total", "grade", "unit_basis", "gst", "review")


def _held(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of which every seventh bill is held for review."""
    held = F.substring("bill_no", 2, 20).cast("long") % 7 == 1
    return lines(spark, folder).withColumns({"review": held, "review_reason": F.when(held, "check").otherwise(""),
                                             "supplier": F.concat(F.lit("Supplier#"), (F.substring("bill_no", 2, 20).cast("long") % 3).cast("string"))})


def printed_points(spark: SparkSession, folder: str) -> DataFrame:
    return operating_points(printed_sweep(sweep(_labelled(spark, folder))), 0.5)


def _to_read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that neither the log knows nor the reader finds too large."""
    docs = documents(spark, folder).select("file_name", (F.col("file_name").cast("long") % 2000).alias("length"), F.sha2("text", 256).alias("sha256"))
    log = docs.where(F.col("file_name").cast("long") % 3 == 0).select("sha256", F.when(F.col("file_name").cast("long") % 2 == 0, "failed").otherwise("done").alias("status"))
    fresh, large = Q.to_process(docs, log, retry_failed=True, max_bytes=1000)
    return fresh.select("file_name", F.lit("read").alias("verdict")).unionByName(large.select("file_name", F.col("status").alias("verdict")))


def _findings(spark: SparkSession, folder: str) -> DataFrame:
    """Every error and warning of every document, one per row."""
    rows = judged(spark, folder)
    both = F.concat(F.transform("errors", lambda e: F.struct(F.lit("error").alias("kind"), e.alias("text"))),
                    F.transform("warnings", lambda e: F.struct(F.lit("warning").alias("kind"), e.alias("text"))))
    return rows.select("file_name", F.inline(both))


def _sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Every line written to CSV files of two layouts, titles above the headers, and read back."""
    rows = lines(spark, folder).select("seq", "part_name", "part_number", "supplier", "bill_no", F.col("total").cast("decimal(18,2)").cast("string").alias("total"), F.col("qty").cast("int").cast("string").alias("qty"))
    place = f"{checkpoint_dir(spark)}/sheets-{uuid.uuid4().hex}"

    def lay_out(part: DataFrame, columns: tuple[str, ...], headers: tuple[str, ...], name: str) -> None:
        quoted = F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])
        top = f"Prices of the year ({name})\n\n{','.join(headers)}\n"
        # The rows of a file keep their order; titles and a header lead each file.
        in_file = Window.partitionBy("file").orderBy("seq")
        body = part.select("seq", F.pmod("seq", F.lit(8)).alias("file"), quoted.alias("value")).withColumn("first", F.row_number().over(in_file) == 1)
        body = body.select("file", F.when(F.col("first"), F.concat(F.lit(top), "value")).otherwise(F.col("value")).alias("value"))
        body.write.partitionBy("file").text(f"{place}/{name}")

    lay_out(rows.where("seq % 2 = 0"), ("part_name", "part_number", "supplier", "bill_no", "total", "qty"),
            ("Part Name", "Part Number", "Supplier", "Bill No", "Total Amount", "Qty"), "a")
    lay_out(rows.where("seq % 2 = 1"), ("qty", "bill_no", "total", "part_number", "supplier", "part_name"),
            ("Quantity", "Invoice No", "Line Total", "Part No.", "Supplier Name", "Particulars of part"), "b")
    read = [enrich_lines(read_bill_sheet(spark, f"{place}/{name}")) for name in ("a", "b")]
    return read[0].unionByName(read[1]).select("part_name", "part_number", "npn", "supplier", "bill_no", "total", "qty", "unit")


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """Replaced twice, upserted by two batches of which one is repeated: what is left, and whether places are unique."""
    table = stored_lines(f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}")
    rows = lines(spark, folder)
    table.replace(rows.where("seq % 3 = 0"))
    table.replace(rows.where("seq % 3 <> 0"))
    table.upsert(rows.where("seq % 5 = 0").withColumn("supplier", F.lit("first")), stream_batch(0))
    table.upsert(rows.where("seq % 10 = 0").withColumn("supplier", F.lit("second")), table.next_batch(spark))
    table.upsert(rows.where("seq % 5 = 0").withColumn("supplier", F.lit("again")), stream_batch(0))
    out = load_lines(spark, table)
    return out.select("id", "supplier", (F.count("*").over(Window.partitionBy("seq")) == 1).alias("own_place"))


def _snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot of other prices of one make, then one of the lines as they are: the second one opened again."""
    root, rows = f"{checkpoint_dir(spark)}/snapshots-{uuid.uuid4().hex}", lines(spark, folder)
    save_snapshot(rows.withColumn("unit", F.when(F.col("make") == "Brand#7", F.col("unit") + 1).otherwise(F.col("unit"))), CATEGORY, root)
    name, _ = save_snapshot(rows, CATEGORY, root)
    return in_cluster_order(load_snapshot(spark, root, name)).withColumn("cluster_id", F.col("cluster_id").cast("string")).drop("cluster_order")


def _streamed_bills(spark: SparkSession, folder: str) -> DataFrame:
    """All documents arriving in two landings, each read by a query of its own; a third start finds nothing new."""
    root = f"{checkpoint_dir(spark)}/bills-{uuid.uuid4().hex}"
    with scratch(spark):
        docs = documents(spark, folder, some_columns).withColumn("path", F.concat(F.lit("/in/"), "file_name"))
        # Texts that can't be read differ, or they would be one document.
        docs = docs.withColumn("text", F.when(F.col("file_name").cast("long") % 17 == 0, F.concat("text", F.lit(" "), "file_name")).otherwise(F.col("text")))
        docs = cut_lineage(docs)
        half = docs.agg(F.percentile_approx(F.col("file_name").cast("long"), 0.5)).first()[0] or 0
        for landed in (F.col("file_name").cast("long") <= half, F.col("file_name").cast("long") > half, F.lit(False)):
            docs.where(landed).select("path", "file_name", "text").write.mode("append").json(f"{root}/landing", compression="gzip")
            bills.start(spark, "", root, answers=stream_answer_lines(spark, f"{root}/landing")).awaitTermination()
    stored = bills.log_table(f"{root}/log").load(spark)
    held = bills.line_table(f"{root}/lines").rows(spark).groupBy(F.col("bill_no").alias("b"), F.col("supplier").alias("s")).agg(F.count("*").cast("int").alias("stored_lines"))
    return stored.join(held, F.col("b").eqNullSafe(F.coalesce("bill_no", F.lit(""))) & F.col("s").eqNullSafe(F.coalesce("supplier", F.lit(""))) & F.col("status").isin("done", "review") & (F.col("bill_no") != ""), "left").select(
        "file_name", "status", "supplier", "bill_no", F.coalesce("lines", F.lit(0)).alias("lines"), "stored_lines")


def _streamed_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events arriving in three landings, the last two repeating ids of earlier ones with another status."""
    root, rows = f"{checkpoint_dir(spark)}/events-{uuid.uuid4().hex}", events(spark, folder).withColumn("id", F.col("id").cast("string"))
    rows = rows.withColumns({"ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")})
    k = F.col("id").cast("long")
    for part in (rows.where(k % 2 == 0), rows.where((k % 2 == 1) | (k % 3 == 0)).withColumn("status", F.lit("warn")), rows.where(k % 5 == 0).withColumn("status", F.lit("done"))):
        part.write.mode("append").json(f"{root}/landing")
        activity.start(spark, f"{root}/landing", f"{root}/log").awaitTermination()
    return activity_table(f"{root}/log").load(spark).select("id", "kind", "source", "status")


def _ingest_again(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in two folders under equal names, judged after every seventh bill was stored."""
    docs = documents(spark, folder).withColumn("k", F.col("file_name").cast("long"))
    docs = docs.select(F.concat(F.lit("/in/"), F.col("file_name")).alias("path"), F.lit("bill.txt").alias("file_name"), "text", "k")
    known = docs.where("k % 7 = 0 and k % 11 <> 0").select(
        F.concat(F.lit("SUPPLIER "), F.col("k") % 2).alias("supplier"), F.concat(F.lit("B"), F.floor(F.col("k") / 3)).alias("bill_no"), F.lit("/old").alias("path"))
    out = Q.judge_documents(docs.drop("k"), known)
    return out.select("path", "status", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


def _worklist(spark: SparkSession, folder: str) -> DataFrame:
    c, v = clusters(spark, folder), variants(spark, folder)
    keys = c.where(F.col("make") == "Brand#3").select("key", (F.col("cluster_order.ord_first")).alias("position"))
    return _shown(worklist(keys, c, v)).select("cluster_id", "part", "make", "quotes", "median", "mean")


def entry(spark: SparkSession) -> DataFrame:
    """The median benchmark per part number on the smallest tables."""
    return _benchmark(EXACT)(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    L, G, V, C = lines, grouped, variants, clusters
    return {
        "e_enrich": lambda s, d: enrich_lines(raw_lines(s, d)),
        "e_features": lambda s, d: with_name_features(L(s, d).select("part_name").distinct(), "part_name").select(
            "part_name", "nn", "pos.*", F.size("tk").alias("n_tokens")),
        "c1_exact_pn": _benchmark(EXACT),
        "c2_category": _benchmark(CATEGORY),
        "c3_fuzzy": _benchmark(DEFAULT),
        "c4_hybrid": _benchmark(HYBRID),
        "c5_bridge": _benchmark(BRIDGED),
        "a4_reconcile": lambda s, d: Q.reconcile_bills(L(s, d), read_table(s, d, "orders").select(
            F.concat(F.lit("B"), F.col("o_orderkey").cast("string")).alias("bill_no"),
            F.lit(0.0).alias("parts_subtotal"), F.col("o_totalprice").alias("invoice_total"))),
        "a5_kpis": lambda s, d: A.kpis(L(s, d), C(s, d)),
        "a6_bills": lambda s, d: A.bills(some_columns(s, d)),
        "a7_types": lambda s, d: A.line_types(L(s, d)),
        "a8_categories": lambda s, d: A.usable_by_category(L(s, d)),
        "a9_bands": lambda s, d: A.size_bands(C(s, d)),
        "a10_makes": lambda s, d: A.by_make(L(s, d), C(s, d)),
        "a11_review": lambda s, d: A.review_queue(enrich_lines(stored_order(
            Q.invoice_lines(judged(s, d)).select("document", "line", "supplier", "bill_no", "review", "review_reason"), "document", "line"))),
        "a12_confidence": lambda s, d: _shown(A.confidence(C(s, d), AS_OF), "as_of"),
        "a13_dispersion": lambda s, d: _shown(A.supplier_dispersion(G(s, d), C(s, d))),
        "a14_agreement": lambda s, d: _shown(A.agreement(C(s, d), V(s, d))),
        "a15_list_net": lambda s, d: A.list_and_net(L(s, d)),
        "a16_same_pn": lambda s, d: A.same_part_number(L(s, d)),
        "a17_trend": lambda s, d: A.trend(L(s, d)).drop("first_seq"),
        "w4_trend_points": lambda s, d: A.trend_points(L(s, d)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)}),
        "w4_points_all": lambda s, d: A.trend_points(L(s, d), categories=None).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)}),
        "a17_trend_all": lambda s, d: A.trend(L(s, d), categories=None).drop("first_seq"),
        "a18_normalised": lambda s, d: A.normalised(C(s, d), V(s, d)),
        "a18_values_all": lambda s, d: A.normalised_values(C(s, d), V(s, d)).select("label", "make", "quotes", "kind", "value", "n"),
        "l4_benchmark_all": lambda s, d: _shown(A.benchmark_view(C(s, d), least_quotes=1)).select("cluster_id", "label", "make", "n", "med", "avg"),
        "e_written": _written,
        "e22_claim_lines": _claim_lines,
        "s16_upgraded": _upgraded,
        "q4_accepted": lambda s, d: Q.accept_bill(_held(s, d), "Supplier#1", "B1").select("id", "review", "review_reason"),
        "q5_discarded": lambda s, d: Q.discard_bill(_held(s, d), "Supplier#1", "B1").select("id", "review"),
        "f1_usable_held": lambda s, d: usable(_held(s, d)).select("id", "ltype"),
        "f5_by_kind": lambda s, d: newest_events(normal_events(events(s, d)), None, "click").select("id", "kind", "count"),
        "u1_appended": lambda s, d: append_lines(L(s, d).select("id", "make", "total"), L(s, d).where("seq % 2 = 0").select("id", "total")),
        "u3_options": lambda s, d: A.distinct_options(L(s, d), "model", F.col("make") == "Brand#7"),
        "v3_points": lambda s, d: printed_points(s, d),
        "f11_to_read": _to_read,
        "q1_findings": _findings,
        "s1_sheets": _sheets,
        "s5_store": _stored,
        "q9_snapshots": _snapshots,
        "t1_ingest": _streamed_bills,
        "t2_events": _streamed_events,
        "q2_ingest_stored": _ingest_again,
        "a19_coverage": lambda s, d: A.coverage(L(s, d), tuple(f"Brand#{i * 2 + 1}" for i in range(17))),
        "a22_run_report": lambda s, d: Q.run_report(judged(s, d)),
        "a23_batches": lambda s, d: Q.batch_summary(L(s, d), "doc_type"),
        "l4_benchmark": lambda s, d: _shown(A.benchmark_view(C(s, d))).select("cluster_id", "label", "make", "n", "med", "avg"),
        "f2_ledger": lambda s, d: A.ledger(L(s, d), "Brand#7", "Supplier Part", "RING").select("id", "make", "ltype", "part_name", "supplier"),
        "f3_lookup": lambda s, d: _shown(A.lookup(C(s, d), V(s, d), models=["ECONOMY", "PROMO"], name="gear", part_number="n-1", search="brand#1")).select(
            "cluster_id", "label", "make", "n", "med"),
        "f6_inflation": lambda s, d: A.inflation(G(s, d), C(s, d)),
        "j6_bill_context": lambda s, d: A.bill_context(L(s, d)).select("id", "bill_no", "bill_lines", "bill_total"),
        "j8_worklist": _worklist,
        "k1_assess": lambda s, d: _shown(assessment(s, d)).select(*_ASSESSED),
        "a20_totals": lambda s, d: totals(assessment(s, d)),
        "k2_lines": lambda s, d: line_table(assessment(s, d), V(s, d)),
        "k3_evidence": lambda s, d: evidence_table(assessment(s, d), G(s, d)).drop("member_rank"),
        "a24_summary": lambda s, d: summary_table(assessment(s, d), L(s, d), DEFAULT, snapshot_id(L(s, d), DEFAULT), "2001-08-02"),
        "q2_ingest": lambda s, d: judged(s, d).select(
            "file_name", "status", "supplier", "bill_no", F.coalesce("lines", F.lit(0)).alias("lines"), "rec_sum", "rec_stated"),
        "s3_invoice_lines": lambda s, d: enrich_lines(Q.invoice_lines(judged(s, d))).select("bill_no", "part_name", "npn", "qty", "unit", "total", "review"),
        "q6_fingerprint": lambda s, d: snapshot_id(L(s, d), DEFAULT),
        "v1_pairs": lambda s, d: candidate_pairs(L(s, d)),
        "v2_sweep": lambda s, d: printed_sweep(sweep(_labelled(s, d))),
        "s7_upsert": _upserted,
        "s8_activity": lambda s, d: newest_events(normal_events(events(s, d))).select(
            "id", "ts", "kind", "count", F.expr("variant_get(detail, '$.k', 'bigint')").alias("k")),
        "s9_retention": lambda s, d: keep_newest(events(s, d)).select("id", "source"),
    } | recent_queries.queries(L, G) | table_queries.queries(L, G, C, V, judged, assessment) | LLM_QUERIES


def oracle_sql() -> dict[str, str]:
    old = oracles()
    return old | recent_queries.oracles() | table_queries.oracles(old) | LLM_ORACLES
