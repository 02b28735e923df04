import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import raw_frame
from pricebench import MatchConfig
from pricebench.operators.clusters import build_clusters, cluster_variants
from pricebench.operators.enrich import enrich_lines
from pricebench.operators.grouping import assign_clusters
from pricebench.operators.quality import invoice_lines, judge_documents
from pricebench.operators import ordering
from pricebench.session import checkpoint_dir, cut_lineage
from pricebench.sources.documents import first_documents, read_answers, read_scans
from pricebench.sources.exports import benchmark_sheet, export_dataset, export_worklist, import_sheet
from pricebench.sources.star import raw_lines
from pricebench.sources.store import activity_table, keep_newest, line_table, load_lines, newest_events, normal_events, seed_lines, stream_batch
from pricebench.sources.tabular import header_layout, read_bill_sheet
from pricebench.streaming import activity as activity_stream, bills as bill_stream
from test_quality import COVER, GOOD, PART


def test_headers_resolve(spark):
    cells = ["Part Description", "Part No", "Unit Basis", "Unit Cost", "Line Amount", "Review Reason", "Review"]
    where = header_layout(spark.createDataFrame([("f", cells)], "path string, cells array<string>")).first().layout
    assert where["part_name"] == 0 and where["part_number"] == 1 and where["unit_cost"] == 2 and where["total_cost"] == 4
    assert (where["review_reason"], where["review"], where["unit_basis"]) == (5, 6, 2)


def test_every_file_has_its_own_layout(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Price list of the year\nPart Name,Part Number,Total Cost\nLAMP,P-1,10\nCLIP,P-2,3\nPrice list of the year\n", encoding="utf8")
    (tmp_path / "b b.csv").write_text("\n" + "note,\n" * 70 + "Total Amount,Qty,Part No,Part Description\n7,2,P-3,HOSE\n8,1,P-4,\"RING, O\"\n", encoding="utf8")
    rows = read_bill_sheet(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.supplier, r.part_name, r.part_number, r.total_cost, r.qty) for r in rows] == [
        ("a", "LAMP", "P-1", "10", "1"), ("a", "CLIP", "P-2", "3", "1"), ("a", "Price list of the year", "", "", "1"),
        ("b b", "HOSE", "P-3", "7", "2"), ("b b", "RING, O", "P-4", "8", "1")]
    assert assign_clusters(enrich_lines(read_bill_sheet(spark, str(tmp_path)))).count() == 4  # the clip is a fastener
    (tmp_path / "c.csv").write_text("nothing,here\n1,2\n")
    with pytest.raises(ValueError, match="c.csv"):
        read_bill_sheet(spark, str(tmp_path))


def test_sheet_with_title_rows(spark, tmp_path):
    (tmp_path / "acme.csv").write_text(
        "Supplier parts list,,,,\n,,,,\nPart Name,Part Number,Qty,Total Cost,Review\n"
        '"LAMP, LH",P-1,2,"10",yes\n,,1,5,\nCLIP,,,3,no\n', encoding="utf8")
    rows = read_bill_sheet(spark, str(tmp_path / "acme.csv")).orderBy("part_name").collect()
    assert [(r.part_name, r.part_number, r.supplier, r.review, r.doc_type) for r in rows] == [
        ("CLIP", "", "acme", False, "Tax Invoice"), ("LAMP, LH", "P-1", "acme", True, "Tax Invoice")]
    lines = enrich_lines(read_bill_sheet(spark, str(tmp_path / "acme.csv"))).where("part_number = 'P-1'").first()
    assert (lines.qty, lines.unit, lines.total) == (2.0, 5.0, 10.0)


def test_finished_documents_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a.pdf", json.dumps(GOOD)), ("b.pdf", json.dumps({**GOOD, "bill_no": "Z", "parts": [PART]}))],
                                 "file_name string, text string")
    raw = invoice_lines(judge_documents(docs))
    import_sheet(raw).coalesce(1).write.csv(str(tmp_path / "out"), header=True)
    back = read_bill_sheet(spark, str(tmp_path / "out")).collect()
    assert len(back) == 3 and [r.review for r in back].count(True) == 1
    assert any("missing or misread" in r.review_reason for r in back)


def line(i, **more):
    return dict(part_name=f"LAMP {i}", part_number=f"P{i}", unit_cost=10 + i, qty=1, make="Kia", id=f"id{i}", seq=i, **more)


def test_line_store(spark, tmp_path):
    table = line_table(str(tmp_path / "lines"))
    assert load_lines(spark, table).count() == 0 and table.next_batch(spark) == 0
    assert seed_lines(table, raw_frame(spark, [line(0), line(1)])) is True
    assert seed_lines(table, raw_frame(spark, [line(2)])) is False and load_lines(spark, table).count() == 2
    changed = enrich_lines(raw_frame(spark, [line(1, supplier="NEW"), line(5)]))
    batch = table.next_batch(spark)
    table.upsert(changed, batch)
    table.upsert(changed, batch)
    rows = {r.id: r for r in load_lines(spark, table).collect()}
    assert sorted(rows) == ["id0", "id1", "id5"] and rows["id1"].supplier == "NEW" and table.rows(spark).count() == 4
    assert [rows[i].seq for i in ("id0", "id1", "id5")] == [0, 1, 2]
    table.replace(cut_lineage(load_lines(spark, table).where("id = 'id5'")))
    assert [r.id for r in load_lines(spark, table).collect()] == ["id5"]
    assert seed_lines(table, raw_frame(spark, [line(7)]), force=True) and load_lines(spark, table).first().id == "id7"


def test_corrections_between_the_batches_of_a_stream(spark, tmp_path):
    root = str(tmp_path)
    table = line_table(f"{root}/lines")
    seed_lines(table, raw_frame(spark, [line(0), line(1)]))
    docs = lambda *texts: spark.createDataFrame([(f"/in/{i}/z.txt", "z.txt", t) for i, t in enumerate(texts)], "path string, file_name string, text string")
    bill_stream.ingest_batch(docs(bill(1)), stream_batch(0), root)
    table.upsert(enrich_lines(raw_frame(spark, [line(1, supplier="NEW"), line(5)])), table.next_batch(spark))
    bill_stream.ingest_batch(docs(bill(1), bill(2, parts=[PART])), stream_batch(1), root)
    rows = load_lines(spark, table).orderBy("seq").collect()
    assert [r.part_name for r in rows[:2]] == ["LAMP 0", "LAMP 1"] and rows[1].supplier == "NEW" and len(rows) == 6
    assert [r.seq for r in rows] == list(range(6)) and [r.bill_no for r in rows] == ["", "", "MG-1", "MG-1", "", "MG-2"]
    assert assign_clusters(load_lines(spark, table)).count() == 5
    bill_stream.ingest_batch(docs(bill(1), bill(2, parts=[PART])), stream_batch(1), root)  # a retry
    assert [(r.id, r.seq) for r in load_lines(spark, table).orderBy("seq").collect()] == [(r.id, r.seq) for r in rows]
    table.replace(cut_lineage(load_lines(spark, table).where("false")))
    assert load_lines(spark, table).count() == 0


def test_last_write_of_a_key_is_decided(spark, tmp_path):
    table = activity_table(str(tmp_path / "log"))
    twice = spark.createDataFrame([("e1", "first"), ("e1", "second")], "id string, source string").coalesce(1)
    table.upsert(twice, stream_batch(0))
    assert table.load(spark).first().source == "second"
    table.upsert(twice.where("source = 'first'"), table.next_batch(spark))
    assert table.load(spark).first().source == "first" and table.load(spark, before=stream_batch(0) + 1).first().source == "second"


def test_documents_are_told_apart_by_place_and_content(spark):
    other = json.dumps({**GOOD, "bill_no": "MG-77"})
    rows = [("/a/z.txt", "z.txt", json.dumps(GOOD)), ("/b/z.txt", "z.txt", other), ("/c/z.txt", "z.txt", json.dumps(GOOD)), ("/c/z.txt", "z.txt", json.dumps(GOOD))]
    judged = {r.path: r for r in judge_documents(spark.createDataFrame(rows, "path string, file_name string, text string")).collect()}
    assert {k: r.status for k, r in judged.items()} == {"/a/z.txt": "done", "/b/z.txt": "done", "/c/z.txt": "duplicate"}
    assert "(/a/z.txt)" in judged["/c/z.txt"].error
    failed = judge_documents(spark.createDataFrame([("x", "no json")], "file_name string, text string")).first()
    assert (failed.status, failed.failed_text) == ("failed", "no json")


@pytest.mark.parametrize("seqs", [(0, 0), (0, None)])
def test_lines_without_a_place_of_their_own_are_refused(spark, seqs):
    lines = enrich_lines(raw_frame(spark, [line(0), line(1)])).withColumn("seq", F.when(F.col("id") == "id0", seqs[0]).otherwise(F.lit(seqs[1]).cast("long")))
    with pytest.raises(ValueError, match="stored order"):
        assign_clusters(lines)


def test_keys_of_any_size_have_places_of_their_own(spark, tmp_path):
    keys = [(9_300_000_000 + i // 4, 100_000 + i % 3, 200_000 + i % 2, i % 9) for i in range(200)]
    spark.createDataFrame([(*k, "2020-01-01", 5.0 + i, 1.0) for i, k in enumerate(keys * 2)],
                          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_shipdate string, l_extendedprice double, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, "P" if o % 2 else "F") for o in {k[0] for k in keys}], "o_orderkey long, o_orderstatus string").withColumn("o_orderdate", F.lit("2020-01-01").cast("date")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(p, "small ring", "B", "T") for p in {k[1] for k in keys}], "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(x, "S") for x in {k[2] for k in keys}], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(r.seq for r in raw_lines(spark, str(tmp_path)).collect()) == list(range(400))


def test_activity_log(spark, tmp_path):
    table = activity_table(str(tmp_path / "log"))
    events = spark.createDataFrame(
        [("e1", "2026-01-01T00:00:00Z", "ocr", "f1", "3", '{"a":1}'), ("e2", "2026-01-02T00:00:00Z", "error", "f1", "x", "not json"),
         ("e3", "2026-01-03T00:00:00Z", "", "f2", None, None)],
        "id string, ts string, kind string, source string, count string, detail string")
    table.upsert(normal_events(events), 0)
    table.upsert(normal_events(events.where("id = 'e1'").withColumn("source", F.lit("again"))), 1)
    shown = newest_events(table.load(spark), 2).selectExpr("id", "kind", "count", "to_json(detail) d").collect()
    assert [(r.id, r.kind, r["count"], r.d) for r in shown] == [("e3", "info", 0, None), ("e2", "error", 0, '{"raw":"not json"}')]
    all_ = table.load(spark)
    assert all_.count() == 3 and all_.where("id = 'e1'").first().source == "again"
    assert newest_events(all_, 0).count() == 1 and newest_events(all_, kind="ocr").count() == 1
    many = spark.range(1200).selectExpr("cast(id as string) id", "cast(id as string) ts", "if(id < 1100, 'a', 'b') source")
    kept = keep_newest(many, 500).groupBy("source").count().collect()
    assert {r.source: r["count"] for r in kept} == {"a": 500, "b": 100}
    assert keep_newest(many, 2).where("source = 'b'").orderBy("id").first().id in {"999"} | {str(i) for i in range(1100, 1200)}


def test_exports(spark, demo, tmp_path):
    cfg = MatchConfig()
    grouped = assign_clusters(demo, cfg).cache()
    variants = cluster_variants(grouped).cache()
    clusters = build_clusters(grouped, cfg, variants).cache()
    export_dataset(demo, clusters, variants, str(tmp_path))
    parts = spark.read.csv(str(tmp_path / "parts"), header=True, quote='"', escape='"')
    assert parts.count() == 174 and "id" not in parts.columns and "src" not in parts.columns
    sheet = benchmark_sheet(clusters, variants).collect()
    assert len(sheet) == 108 and sheet[0].Quotes == 2 and sheet[0].Reliable == "no" and sheet[-1].Reliable is None
    keys = clusters.where("n > 1").select("key", F.col("cluster_order.ord_first").alias("position"))
    export_worklist(keys, clusters, variants, grouped, str(tmp_path / "w"))
    assert spark.read.csv(str(tmp_path / "w" / "evidence"), header=True).count() >= 2


def test_documents(spark, tmp_path):
    (tmp_path / "b.txt").write_text("two\nlines")
    (tmp_path / "a.txt").write_text("x")
    docs = read_answers(spark, str(tmp_path))
    assert [(r.file_name, r.text) for r in docs.orderBy("file_name").collect()] == [("a.txt", "x"), ("b.txt", "two\nlines")]
    assert first_documents(docs, 1).first().file_name == "a.txt"
    scan = read_scans(spark, str(tmp_path)).where("file_name = 'a.txt'").first()
    assert scan.length == 1 and scan.sha256.startswith("2d711642b726b044")


def bill(n, **more):
    return json.dumps({**GOOD, "bill_no": f"MG-{n}", **more})


def test_bill_stream(spark, tmp_path):
    landing, root = tmp_path / "in", str(tmp_path / "out")
    landing.mkdir()

    def run():
        query = bill_stream.start(spark, str(landing), root)
        query.awaitTermination(120)
        lines = load_lines(spark, line_table(f"{root}/lines"))
        log = bill_stream.log_table(f"{root}/log").load(spark)
        return lines, {r.file_name: r.status for r in log.collect()}

    (landing / "a.txt").write_text(bill(1))
    (landing / "b.txt").write_text(bill(2, parts=[PART]))
    (landing / "c.txt").write_text("no json")
    lines, log = run()
    assert log == {"a.txt": "done", "b.txt": "review", "c.txt": "failed"} and lines.count() == 3
    (landing / "d.txt").write_text(bill(1, supplier_name="GOOD AUTO"))
    (landing / "e.txt").write_text(bill(3))
    lines, log = run()
    assert (log["d.txt"], log["e.txt"]) == ("duplicate", "done") and lines.count() == 5
    seqs = [r.seq for r in lines.orderBy("seq").collect()]
    assert len(set(seqs)) == 5 and lines.orderBy("seq").first().bill_no == "MG-1"
    lines, log = run()
    assert lines.count() == 5 and len(log) == 5
    # The second batch again: it is judged against the first one only and replaces itself.
    again = spark.createDataFrame([(f.name, f.read_text()) for f in landing.iterdir() if f.name in ("d.txt", "e.txt")], "file_name string, text string")
    bill_stream.ingest_batch(again, stream_batch(1), root)
    assert load_lines(spark, line_table(f"{root}/lines")).count() == 5
    assert activity_table(f"{root}/activity").load(spark).count() == 2


def test_activity_stream(spark, tmp_path):
    landing, path = tmp_path / "in", str(tmp_path / "log")
    landing.mkdir()
    event = {"id": "e1", "ts": "2026-01-01T00:00:00Z", "kind": "ocr", "count": 2, "source": "old"}
    later = {**event, "ts": "2026-01-01T00:00:01Z", "source": "new"}
    (landing / "1.json").write_text(json.dumps(later) + "\n" + json.dumps(event) + "\n")
    activity_stream.start(spark, str(landing), path).awaitTermination(60)
    (landing / "2.json").write_text(json.dumps({**event, "id": "e2"}) + "\n")
    activity_stream.start(spark, str(landing), path).awaitTermination(60)
    rows = {r.id: r.source for r in activity_table(path).load(spark).collect()}
    assert rows == {"e1": "new", "e2": "old"}
    assert activity_stream.by_kind(activity_table(path).load(spark)).first().events == 2


def test_scans_of_many_folders(spark, tmp_path):
    import table_queries

    supplier = spark.createDataFrame([(k, f"S{k}") for k in (12, 3, 10, 1, 100)] + [(3, "S3b")], "s_suppkey long, s_name string")
    supplier.repartition(2).write.parquet(str(tmp_path / "supplier.parquet"))
    got = table_queries._scans(spark, str(tmp_path))
    assert sorted((r.k, r.length, r.file_name) for r in got.collect()) == [(1, 3, "k=1"), (3, 7, "k=3"), (10, 4, "k=10"), (12, 4, "k=12"), (100, 5, "k=100")]
    assert [r.k for r in first_documents(got, 4).collect()] == [1, 10, 100, 12]
    (tmp_path / "in" / "a" / "b").mkdir(parents=True)
    (tmp_path / "in" / "a" / "b" / "s.txt").write_text("x")
    (tmp_path / "in" / "a" / "other.pdf").write_text("y")
    assert [r.file_name for r in read_scans(spark, str(tmp_path / "in"), nested="*.txt").collect()] == ["s.txt"]


def test_a_batch_checks_its_texts_once(spark, tmp_path, monkeypatch):
    from pricebench.operators import quality

    calls = []
    monkeypatch.setattr(quality, "validate_invoices", lambda parsed, whole=quality.validate_invoices: calls.append(1) or whole(parsed))
    rows = [("/a", "a", json.dumps(GOOD)), ("/b", "b", "nothing"), ("/c", "c", json.dumps(GOOD | {"invoice_total": 1.0}))]
    docs = spark.createDataFrame(rows, "path string, file_name string, text string")
    bill_stream.ingest_batch(docs, 0, str(tmp_path))
    assert calls == [1]
    log = {r.path: (r.status, r.failed_text) for r in bill_stream.log_table(f"{tmp_path}/log").load(spark).collect()}
    assert log == {"/a": ("done", None), "/b": ("failed", "nothing"), "/c": ("duplicate", None)}
    kept = quality.check_documents(docs)
    assert {r.path: r.text for r in kept.collect()} == {"/a": None, "/b": "nothing", "/c": None}


def test_only_keys_of_stored_lines_are_put_in_order(spark, tmp_path, monkeypatch):
    table, stored = line_table(str(tmp_path / "lines")), []
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: stored.append(set(df.columns)) or cut_lineage(df))
    lines = enrich_lines(raw_frame(spark, [line(i) for i in range(6)]))
    table.replace(lines.withColumn("id", F.when(F.col("seq") > 3, None).otherwise(F.col("id"))))
    table.upsert(lines.where("seq IN (0, 5)").withColumn("supplier", F.lit("new")), stream_batch(0))
    rows = load_lines(spark, table).orderBy("seq").collect()
    assert [(r.seq, r.id, r.supplier) for r in rows] == [(0, "id0", "new"), (1, "id1", ""), (2, "id2", ""), (3, "id3", ""), (4, None, ""), (5, "id5", "new")]
    assert stored and not any(c & {"part_name", "supplier"} for c in stored)


def test_exports_can_be_compressed(spark, demo, tmp_path):
    clusters = build_clusters(grouped := assign_clusters(demo, MatchConfig(mode="exact-pn")))
    variants = cluster_variants(grouped)
    for name in ("none", "gzip"):
        export_dataset(demo, clusters, variants, str(tmp_path / name), name)
        files = [f for _, _, fs in os.walk(tmp_path / name) for f in fs if f.startswith("part-")]
        assert files and all(f.endswith(".csv.gz" if name == "gzip" else ".csv") for f in files)
    for sheet in ("parts", "benchmark"):
        plain, packed = (sorted(map(str, spark.read.csv(str(tmp_path / n / sheet), header=True, quote='"', escape='"').collect())) for n in ("none", "gzip"))
        assert plain == packed and plain


def test_a_batch_of_bills_leaves_only_its_tables(spark, tmp_path):
    docs = spark.createDataFrame([("/in/a", "a", bill(1)), ("/in/b", "b", "no json")], "path string, file_name string, text string")
    place = f"{checkpoint_dir(spark)}/pricebench"
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    bill_stream.ingest_batch(docs, stream_batch(0), str(tmp_path))
    assert set(os.listdir(place)) == before and line_table(f"{tmp_path}/lines").rows(spark).count() == 2
